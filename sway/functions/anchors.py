"""Anchors that make a search for substrings an equality join.

Of each window of WINDOW consecutive GRAM-character pieces the one with the smallest hash is an
anchor.  A text of at least GRAM + WINDOW - 1 characters has one in its first window, and any
text that contains it contains that window, hence has the same anchor.  No match can be lost;
candidates that share an anchor are then compared in full.

Where probes are long, so are the grams: texts that share a short gram are many and grow with the data, texts that share
most of a probe are its copies.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 10, 11
SHORTEST = GRAM + WINDOW - 1
LONGEST = 50


#: Gram length of each class of probes by the least length of its probes, and the longest probe.
LONGEST = 50
CLASSES = ((SHORTEST, GRAM), (30, 20), (LONGEST, 40))
#: Bits of the map that tells which anchors a probe can want: so many an anchor, within bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
#: An anchor has two bits, from either end of its hash: the higher one begins here.
HIGH = 35
#: Characters of a text that are hashed at a time.
PIECE = 1 << 16
_BASE = 0x100000001B3


def _mixed(value: np.ndarray) -> np.ndarray:
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashed(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams along the last axis."""
    n = points.shape[-1] - gram + 1
    value = np.zeros((*points.shape[:-1], n), np.uint64)
    for k in range(gram):
        value = value * np.uint64(_BASE) + points[..., k:k + n]
    return _mixed(value)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    n = PIECE + LONGEST + WINDOW
    up, down = (np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, np.concatenate([np.ones(1, np.uint64), down[:-1]])


def _summed(points: np.ndarray) -> np.ndarray:
    """Sums up to each place, from which ``_rolled`` has the grams of any length."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _powers()[1][:len(points)])])


def _rolled(sums: np.ndarray, gram: int) -> np.ndarray:
    """``_hashed`` of a piece of at most PIECE + LONGEST + WINDOW places."""
    n = len(sums) - gram
    at = _powers()[0][max(0, gram - 2):gram - 2 + n] if gram > 1 else np.concatenate([np.ones(1, np.uint64), _powers()[0][:n - 1]])
    return _mixed((sums[gram:] - sums[:-gram]) * at)


def _first_least(value: np.ndarray) -> np.ndarray:
    """Place of the first smallest value (by its upper half) of each WINDOW consecutive ones."""
    least, off, size = (value >> np.uint64(32)).astype(np.uint32), np.zeros(len(value), np.uint8), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        later = np.negative((least[step:] < least[:-step]).view(np.uint8))  # all bits or none
        left, right = off[:-step], off[step:] + np.uint8(step)
        off = left ^ ((left ^ right) & later)
        least, size = np.minimum(least[step:], least[:-step]), size + step
    return np.arange(len(off)) + off


def _anchors(points: np.ndarray, grams: tuple = (GRAM,)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the anchors of all windows: of each WINDOW consecutive grams the first with the smallest hash."""
    out: list = [[] for _ in grams]
    more = max(grams) + WINDOW - 2  # a window that begins in a piece ends in what is added to it
    for start in range(0, max(1, len(points) - min(grams) - WINDOW + 2), PIECE):
        piece = points[start:start + PIECE + more]
        sums = _summed(piece)
        for k, gram in enumerate(grams):
            if len(piece) >= gram + WINDOW - 1:
                value = _rolled(sums, gram)
                at = _first_least(value)
                at = at[np.concatenate([[True], at[1:] > at[:-1]])]  # places never go back from window to window
                out[k].append((at + start, value[at].view(np.int64)))
    pairs = []
    for found in out:
        at, value = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        if len(found) > 1:  # pieces share windows
            at, first = np.unique(at, return_index=True)
            value = value[first]
        pairs.append((at, value))
    return pairs


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)


def text_anchors(text: str | None) -> np.ndarray:
    """Distinct anchors of all windows of a text (none if it is too short)."""
    return np.unique(_anchors(_points(text))[0][1])


def passages(text: str | None, wanted: np.ndarray | None = None) -> list[tuple]:
    """(gram, anchor, passage, lead) of a text, distinct, for each class of probes: around each anchor, the WINDOW - 1
    characters before it and as many from it on as the longest probe of its class can reach; ``lead`` of them lie before
    the anchor.  Of ``wanted``, a bit map of anchors, only anchors that are set count."""
    out, grams = set(), tuple(gram for _, gram in CLASSES)
    for gram, high, (at, value) in zip(grams, [low - 1 for low, _ in CLASSES[1:]] + [LONGEST], _anchors(_points(text), grams)):
        if wanted is not None:
            for shift in (0, HIGH):
                bit = (value.view(np.uint64) >> np.uint64(shift)) & np.uint64(len(wanted) * 8 - 1)
                some = (wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, value = at[some], value[some]
        for a, v in zip(at.tolist(), value.tolist()):
            start = max(0, a - WINDOW + 1)
            out.add((gram, v, text[start:a + high], a - start))
    return list(out)


def probe_anchor(probes: list[str]) -> list[tuple]:
    """(gram, anchor, offset) of the anchor in the first window of each probe, by the class of its length."""
    out: list = [None] * len(probes)
    for (low, gram), high in zip(CLASSES, [c[0] for c in CLASSES[1:]] + [math.inf]):
        rows = [i for i, p in enumerate(probes) if low <= len(p) < high]
        points = _points("".join(probes[i][:gram + WINDOW - 1] for i in rows)).reshape(len(rows), gram + WINDOW - 1)
        value = _hashed(points, gram)
        at = (value >> np.uint64(32)).argmin(axis=1)
        for i, v, a in zip(rows, value[np.arange(len(rows)), at].view(np.int64).tolist(), at.tolist()):
            out[i] = (gram, v, a)
    return out


def probe_anchors(probe: str):
    """Column of ``probe_anchor``, as an array of one."""
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(probe_anchor(s.tolist()), columns=["gram", "anchor", "offset"])
    return F.array(F.pandas_udf(run, "gram int, anchor long, offset int")(probe))


def bits_for(anchors: int) -> int:
    """Size of the map for so many anchors, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, anchors) - 1).bit_length()))


def wanted_bits(wanted: DataFrame) -> np.ndarray:
    """The bit map of the column ``anchor``, two bits each: MOST_BITS / 8 bytes at most.  It grows with the
    anchors: in a map of fixed size, the more are wanted, the more that nobody wants pass too."""
    size = bits_for(wanted.count())
    low = F.col("anchor").bitwiseAND(F.lit(size - 1))
    high = F.shiftrightunsigned("anchor", HIGH).bitwiseAND(F.lit(size - 1))
    held = np.zeros(size // 8, np.uint8)
    x = wanted.select(F.explode(F.array(low, high)).alias("x")).select((F.col("x") + 1).alias("x"))
    x = x.select("x", F.bitmap_bucket_number("x").alias("b")).repartition("b")  # places move, not maps that are all but empty
    for b, bits in x.groupBy("b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("x"))).collect():
        held[(b - 1) * len(bits):b * len(bits)] = np.frombuffer(bits, np.uint8)
    return held


def text_passages(text: str, wanted: DataFrame):
    """Column of the ``passages`` whose anchors the rows of ``wanted`` may want."""
    bits = wanted.sparkSession.sparkContext.broadcast(wanted_bits(wanted))
    return F.udf(lambda t: passages(t, bits.value), "array<struct<gram:int,anchor:long,passage:string,lead:int>>", useArrow=False)(text)
