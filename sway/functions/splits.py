"""Resample counts by hierarchical splitting (numpy, for pandas UDFs).

n draws with replacement from n sorted items are never made one by one.  A node of a binary tree over the positions
holds a range of positions and the number of draws that fall into it; how many go to its left half is one binomial
draw, keyed by (group, replicate, node), so every task, retry and engine that asks for a node gets the same number.
A position of a given rank is found by going down the tree, and only the nodes on the way are resolved.
"""

from __future__ import annotations

import numpy as np

from sway.functions.dist import lgamma

PRIME = 2147483647


def _power5(t: np.ndarray) -> np.ndarray:
    """Fifth power modulo PRIME: a permutation, as 5 doesn't divide PRIME - 1."""
    square = t * t % PRIME
    return square * square % PRIME * t % PRIME


def uniform(salt, replicate, node) -> np.ndarray:
    """Keyed uniform numbers in (0, 1): whole-number mixing below 2^62, the same in any engine."""
    salt, replicate, node = (np.asarray(x, np.int64) for x in (salt, replicate, node))
    t = (salt + replicate * 48271 + node * 69621) % PRIME
    for k in (replicate, node, salt):
        t = (_power5(t) + k) % PRIME
    return (t + 0.5) / PRIME


def uniform_sql(salt: str, replicate: str, node: str) -> str:
    """``uniform`` as a SQL expression."""
    t = f"(({salt} + {replicate} * 48271 + {node} * 69621) % {PRIME})"
    for k in (replicate, node, salt):
        # the fifth power by a list, so that the inner expression is written once
        t = (f"(list_reduce([{t}, 2, 1], lambda t, e: CASE e WHEN 2 THEN ((t * t % {PRIME}) * (t * t % {PRIME}) % {PRIME}) * t % {PRIME} ELSE t END)"
             f" + {k}) % {PRIME}")
    return f"(({t}) + 0.5) / {PRIME}"


def binomial(u, m, p) -> np.ndarray:
    """Binomial(m, p) numbers from uniform ones: outcomes are taken from the mode outwards (mode, one more, one
    less, two more, ...) until their probabilities exceed u, so the work grows with the standard deviation."""
    u, m, p = np.broadcast_arrays(np.asarray(u, float), np.asarray(m, np.int64), np.asarray(p, float))
    u, m, p = (x.ravel().copy() for x in (u, m, p))
    mode = np.minimum(np.floor((m + 1) * p), m).astype(np.int64)
    odds = p / (1 - p)
    up = np.exp(lgamma(m + 1.0) - lgamma(mode + 1.0) - lgamma(m - mode + 1.0) + mode * np.log(p) + (m - mode) * np.log1p(-p))
    down, seen = up.copy(), up.copy()
    out = mode.copy()
    left = np.flatnonzero((u >= seen) & (m > 0))
    step = 0
    while len(left):
        step += 1
        at, mm, oo = mode[left], m[left], odds[left]
        high, low = at + step, at - step
        up[left] = np.where(high <= mm, up[left] * (mm - high + 1) / high * oo, 0.0)
        seen[left] += up[left]
        hit = u[left] < seen[left]
        out[left[hit]] = high[hit]
        down[left] = np.where(low >= 0, down[left] * (low + 1) / np.maximum(mm - low, 1) / oo, 0.0)
        seen[left] += np.where(hit, 0.0, down[left])
        also = ~hit & (u[left] < seen[left])
        out[left[also]] = low[also]
        done = hit | also | ((up[left] == 0.0) & (down[left] == 0.0))
        left = left[~done]
    return out


def position_of_rank(n, rank, salt, replicate) -> np.ndarray:
    """Position (0 to n - 1) of the draw of the given rank (from 1) among n draws from n sorted items."""
    n, rank, salt, replicate = (np.asarray(x, np.int64).copy() for x in np.broadcast_arrays(n, rank, salt, replicate))
    low, high, draws, node = np.zeros_like(n), n.copy(), n.copy(), np.ones_like(n)
    while True:
        open_ = np.flatnonzero(high - low > 1)
        if not len(open_):
            return low
        lo, hi = low[open_], high[open_]
        middle = (lo + hi) // 2
        left = binomial(uniform(salt[open_], replicate[open_], node[open_]), draws[open_], (middle - lo) / (hi - lo))
        goes = rank[open_] <= left
        low[open_], high[open_] = np.where(goes, lo, middle), np.where(goes, middle, hi)
        rank[open_] = np.where(goes, rank[open_], rank[open_] - left)
        draws[open_] = np.where(goes, left, draws[open_] - left)
        node[open_] = 2 * node[open_] + np.where(goes, 0, 1)


def binomial_sql(u: str, m: str, p: str) -> str:
    """``binomial`` as a SQL expression over columns (their names)."""
    mode = f"least(floor(({m} + 1) * {p}), {m})::BIGINT"
    first = (f"exp(lgamma({m} + 1.0) - lgamma({mode} + 1.0) - lgamma({m} - {mode} + 1.0) + {mode} * ln({p}) + ({m} - {mode}) * ln(1 - {p}))")
    up = f"(CASE WHEN {mode} + e.s <= {m} THEN a.up * ({m} - ({mode} + e.s) + 1) / ({mode} + e.s) * ({p} / (1 - {p})) ELSE 0 END)"
    down = f"(CASE WHEN {mode} - e.s >= 0 THEN a.down * ({mode} - e.s + 1) / ({m} - ({mode} - e.s)) / ({p} / (1 - {p})) ELSE 0 END)"
    start = f"{{'s': 0::BIGINT, 'up': {first}, 'down': {first}, 'seen': {first}, 'x': CASE WHEN {m} = 0 OR {u} < {first} THEN {mode} ELSE -1 END}}"
    steps = f"list_transform(range(1, (12 * sqrt({m} * {p} * (1 - {p})))::BIGINT + 60), lambda i: {{'s': i, 'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'seen': 0.0::DOUBLE, 'x': (-1)::BIGINT}})"
    walk = (f"list_reduce(list_concat([{start}], {steps}), lambda a, e: CASE WHEN a.x >= 0 THEN a ELSE {{'s': e.s, 'up': {up}, 'down': {down}, 'seen': a.seen + {up} + {down}, "
            f"'x': CASE WHEN {u} < a.seen + {up} THEN {mode} + e.s WHEN {u} < a.seen + {up} + {down} THEN {mode} - e.s ELSE -1 END}} END)")
    return f"(CASE WHEN ({walk}).x < 0 THEN {mode} ELSE ({walk}).x END)"


def positions_ctes(groups: str, keys: list[str], n_boot: int, name: str = "drawn") -> str:
    """Recursive CTE ``name`` (keys, b, i): the positions of both middle ranks of each replicate of each group of
    the relation ``groups`` (keys, n, salt).  To be used behind WITH RECURSIVE."""
    k = ", ".join(keys)
    return f"""
{name}_tree AS (
  SELECT {k}, salt, b.b, r.r AS rank, 0::BIGINT AS lo, n AS hi, n AS draws, 1::BIGINT AS node
  FROM {groups}, range(1, {n_boot} + 1) b(b), (SELECT unnest([0, 1]) AS second) s, LATERAL (SELECT CASE s.second WHEN 0 THEN (n + 1) // 2 ELSE n // 2 + 1 END AS r) r
  UNION ALL
  SELECT {k}, salt, b, CASE WHEN rank <= x THEN rank ELSE rank - x END, CASE WHEN rank <= x THEN lo ELSE mid END, CASE WHEN rank <= x THEN mid ELSE hi END,
    CASE WHEN rank <= x THEN x ELSE draws - x END, 2 * node + CASE WHEN rank <= x THEN 0 ELSE 1 END
  FROM (SELECT *, {binomial_sql('u', 'draws', 'p')} AS x FROM (
    SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) / (hi - lo)::DOUBLE AS p, {uniform_sql('salt', 'b', 'node')} AS u FROM {name}_tree WHERE hi - lo > 1))),
{name} AS (SELECT {k}, b, lo AS i FROM {name}_tree WHERE hi - lo = 1)"""
