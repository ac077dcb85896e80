"""Exact top-k search by inner product over M-trees.

Inner product becomes a metric by one more coordinate: with M the largest squared length of any
vector, x gets sqrt(M - |x|^2) and a query gets 0; then the Euclidean distance d fulfils
d^2 = |q|^2 + M - 2 q.x, so the k nearest are the k highest scores.

The vectors are split by their nearest pivot (pivots are a bounded sample; they only decide
where a vector is stored) and, if many share one, further by a hash.  Each part is an M-tree
whose pages are rows of a table in the shared folder: a page has its centre, covering
radius and parent's place, and leaf pages hold their vectors with the distances to the
centre.  A query visits the pages of a part in the order of their least possible distance and stops when
this exceeds its k-th best; inside a page, entries whose stored parent distance already
rules them out by the triangle inequality are not computed.

A query first searches the part it would be stored in; the k-th best score found there bounds
the second round, which visits only the parts whose ball may hold a better one.  Queries come in
blocks, so no task gets more than a block of queries with one part's pages.  Scores are exact integers, of any size
(where products may exceed a long they are taken in Python's integers); floating-point distances only
prune, with a margin.  Rows are told apart by a number of their own, so rows may repeat an id.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import prepare, shared_table

#: Vectors in a part (on average), entries of a page, pivots at most, queries in a block (on average).
PART_ROWS, PAGE, PIVOTS, QUERY_BLOCK = 4096, 128, 1024, 4096
#: Larger components count as this: then any score has at most 38 digits (of up to 256 dimensions).
LARGEST = 1 << 59

PAGES = ("part long, page int, leaf boolean, centre array<long>, entries binary, to_centre binary, radii binary, refs binary")


@dataclass
class Page:
    """A node: its entries (vectors, or centres of the pages below) and their distances to its centre."""

    leaf: bool
    centre: np.ndarray
    entries: np.ndarray
    to_centre: np.ndarray
    radii: np.ndarray
    refs: np.ndarray  # (id, row) of vectors, or numbers of pages


def distances(x: np.ndarray, to: np.ndarray, most: float) -> np.ndarray:
    """Distances of stored vectors to a stored one, in the space with the added coordinate."""
    x, to = x.astype(np.float64), to.astype(np.float64)
    added = lambda v: np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=-1)))
    return np.sqrt(((x - to) ** 2).sum(axis=-1) + (added(x) - added(to)) ** 2)


def query_distances(x: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Distances of stored vectors to a query (whose added coordinate is 0)."""
    x, query = x.astype(np.float64), query.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (query * query).sum() + most - 2 * (x @ query)))


def build(ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, most: float) -> list[Page]:
    """Bulk-load an M-tree; page 0 is the root, with the given centre."""
    pages: list[Page] = []
    rng = np.random.default_rng(0)

    def load(rows: np.ndarray, centre: np.ndarray) -> int:
        number = len(pages)
        if len(rows) <= PAGE:
            pages.append(Page(True, centre, vectors[rows], distances(vectors[rows], centre, most), np.empty(0), ids[rows]))
            return number
        pages.append(None)  # its number comes before those of the pages below
        picked = rng.choice(rows, min(PAGE, -(-2 * len(rows) // PAGE)), replace=False)
        centres = np.unique(vectors[picked], axis=0)
        nearest = np.argmin(np.stack([distances(vectors[rows], c, most) for c in centres]), axis=0)
        groups = [rows[nearest == i] for i in range(len(centres))]
        if len(centres) == 1:  # equal or nearly equal vectors: any split will do
            groups = np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
            centres = np.repeat(centres, len(groups), axis=0)
        kept = [(c, g) for c, g in zip(centres, groups, strict=True) if len(g)]
        refs = np.array([load(g, c) for c, g in kept], np.int64)
        radii = np.array([distances(vectors[g], c, most).max() for c, g in kept])
        entries = np.array([c for c, _ in kept])
        pages[number] = Page(False, centre, entries, distances(entries, centre, most), radii, refs)
        return number

    load(np.arange(len(ids)), centre)
    return pages


def inner_products(entries: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products with a query, none beyond ``most``: in doubles where these hold every whole number up to
    it, in longs where they fit, else in Python's integers."""
    if most < 1 << 52:
        return (entries.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return entries @ query if most < 1 << 62 else entries.astype(object) @ query.astype(object)


def search(pages: dict[int, Page], query: np.ndarray, own: int, k: int, most: float, bound: int | None = None,
           computed: list[int] | None = None) -> list[tuple[int, int, int]]:
    """The k best (score, id, row) of a tree, best first, ties to the smaller id and row, without the row ``own``.

    With ``bound``, scores below it are of no interest.  ``computed`` counts the inner products."""
    squares, norm = float((query.astype(np.float64) ** 2).sum()), float(np.abs(query.astype(np.float64)).sum())
    reach = np.sqrt(most) * norm  # no component exceeds the longest vector
    margin = 1e-7 * (np.sqrt(squares + most) + 1)
    limit = lambda score: np.sqrt(max(0.0, squares + most - 2.0 * score)) + margin
    best: list[tuple[int, int, int]] = []  # (score, -id, -row), worst first
    far = np.inf if bound is None else limit(bound)
    root = float(query_distances(pages[0].centre[None], query, most)[0])
    turn = itertools.count()
    waiting = [(0.0, next(turn), 0, root)]  # least possible distance, tie, page, distance of its centre
    done = 1
    while waiting and waiting[0][0] <= far:
        _, _, number, to_query = heapq.heappop(waiting)
        page = pages[number]
        apart = far if page.leaf else far + page.radii
        near = np.flatnonzero(np.abs(to_query - page.to_centre) <= apart + margin)
        if not len(near):
            continue
        done += len(near)
        if not page.leaf:
            gaps = query_distances(page.entries[near], query, most)
            for gap, ref, radius in zip(gaps.tolist(), page.refs[near].tolist(), page.radii[near].tolist(), strict=True):
                if gap - radius <= far:
                    heapq.heappush(waiting, (max(0.0, gap - radius), next(turn), ref, gap))
            continue
        entries = page.entries[near]
        largest = reach if reach < 1 << 62 else float(np.abs(entries.astype(np.float64)).max()) * norm
        scores = inner_products(entries, query, largest)
        least = best[0][0] if len(best) == k else bound
        if least is not None:
            better = np.flatnonzero(scores >= least)
            if not len(better):
                continue
            near, scores = near[better], scores[better]
        for score, (vec, row) in zip(scores.tolist(), page.refs[near].tolist(), strict=True):
            if row == own:
                continue
            item = (score, -vec, -row)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            far = min(far, limit(best[0][0]))
    if computed is not None:
        computed.append(done)
    return [(s, -i, -r) for s, i, r in sorted(best, reverse=True)]


def to_frame(part: int, pages: list[Page]) -> pd.DataFrame:
    return pd.DataFrame([(part, i, p.leaf, p.centre, p.entries.astype(np.int64).tobytes(), p.to_centre.tobytes(), p.radii.tobytes(), p.refs.astype(np.int64).tobytes())
                         for i, p in enumerate(pages)], columns=["part", "page", "leaf", "centre", "entries", "to_centre", "radii", "refs"])


def from_frame(frame: pd.DataFrame) -> dict[int, Page]:
    out = {}
    for r in frame.itertuples():
        centre, refs = np.asarray(r.centre, np.int64), np.frombuffer(r.refs, np.int64)
        refs = refs.reshape(-1, 2) if r.leaf else refs
        out[r.page] = Page(r.leaf, centre, np.frombuffer(r.entries, np.int64).reshape(len(refs), len(centre)),
                           np.frombuffer(r.to_centre), np.frombuffer(r.radii), refs)
    return out


def clean(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """(id, row, vec): rows with an id whose vector has finite components, each with a number of its own."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x).cast("long")))
    return (df.select(F.col(key).cast("long").alias("id"), vector.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
            .select("id", F.monotonically_increasing_id().alias("row"), F.transform("vec", whole).alias("vec")))


def top_k(df: DataFrame, vector: Column, queries: Column, k: int = 5, key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of every query against all other rows.

    ``vector`` (an array of doubles) is floored to integers; ``queries`` is a condition on the
    column ``id``.  Ties go to the smaller id; fewer rows give fewer ranks.  Scores are decimals of 38 digits.  Rows without
    an id or with a null or non-finite component take no part; components beyond 2^59 count as that;
    rows that repeat an id are queries and candidates of their own (also of each other); shorter vectors
    count as padded with zeros; an empty table gives no rows."""
    prepare(df.sparkSession)
    rows = shared_table(clean(df, key, vector), "vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most, dims = rows.agg(F.count("*"), F.max(squares), F.max(F.size("vec"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score decimal(38,0)")
    most, dims = float(most) * (1 + 1e-12), max(1, dims)
    padded = rows.select("id", "row", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vec"))).alias("vec"))
    count = max(1, min(PIVOTS, n // PART_ROWS))
    pivots = np.unique(np.array([r["vec"] for r in padded.orderBy(F.xxhash64("row"), "row").limit(count).collect()], np.int64).reshape(-1, dims), axis=0)

    def nearest(frames):
        for f in frames:
            x = np.array(f["vec"].tolist(), np.int64).reshape(-1, dims)
            gaps = np.stack([distances(x, p, most) for p in pivots]) if len(x) else np.empty((len(pivots), 0))
            yield f.assign(pivot=gaps.argmin(axis=0).astype(np.int32), gap=gaps.min(axis=0) if len(x) else np.empty(0))

    placed = shared_table(padded.mapInPandas(nearest, "id long, row long, vec array<long>, pivot int, gap double"), "placed")
    # One row per pivot: how many hash parts its vectors need, and their ball.
    held = {r["pivot"]: (-(-r["n"] // PART_ROWS), r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    cuts = F.lit([held.get(i, (0, 0.0))[0] for i in range(len(pivots))])
    part_of = lambda pivot, cut: pivot.cast("long") * (1 << 32) + cut
    stored = placed.withColumn("part", part_of(F.col("pivot"), F.pmod(F.xxhash64("row"), F.get(cuts, F.col("pivot")))))

    def pages_of(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        return to_frame(part, build(frame[["id", "row"]].to_numpy(np.int64), np.array(frame["vec"].tolist(), np.int64), pivots[part >> 32], most))

    pages = shared_table(stored.select("part", "id", "row", "vec").groupBy("part").applyInPandas(pages_of, PAGES), "pages")
    asked = stored.where(queries).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "vec", "part")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    hits = "query_id long, query_row long, vec_id long, vec_row long, score string"

    def visit(pairs: DataFrame) -> DataFrame:
        """Hits of (query_id, query_row, vec, part, bound) rows, each with one part's pages."""
        pairs = pairs.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)))
        wanted = (pages.join(pairs.select(F.col("part").alias("of"), F.col("block").alias("by")).distinct(), F.col("part") == F.col("of"))
                  .drop("of").withColumn("block", F.col("by") + 0).drop("by"))

        def run(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            tree = from_frame(nodes) if len(nodes) and len(asked) else {}
            out = [(q, own, i, r, str(s)) for q, own, v, b in zip(asked["query_id"].tolist(), asked["query_row"].tolist(), asked["vec"].tolist(), asked["bound"].tolist(), strict=True)
                   for s, i, r in search(tree, np.asarray(v, np.int64), own, k, most, None if pd.isna(b) else int(b))]
            frame = pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "vec_row", "score"])
            return frame.astype({c: "int64" for c in ("query_id", "query_row", "vec_id", "vec_row")})

        return (wanted.groupBy("part", "block").cogroup(pairs.select("query_id", "query_row", "vec", "part", F.col("bound").cast("string").alias("bound"), "block").groupBy("part", "block"))
                .applyInPandas(run, hits).withColumn("score", F.col("score").cast("decimal(38,0)")))

    first = shared_table(visit(asked.withColumn("bound", F.lit(None).cast("string"))), "first")
    bounds = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_row", F.col("least").cast("string").alias("bound"))

    def reach(frames):
        """The pivots whose ball may hold a score of at least the bound."""
        radii = np.array([held.get(i, (0, -np.inf))[1] for i in range(len(pivots))])
        for f in frames:
            out = []
            for q, own, v, part, b in zip(f["query_id"].tolist(), f["query_row"].tolist(), f["vec"].tolist(), f["part"].tolist(), f["bound"].tolist(), strict=True):
                v = np.asarray(v, np.int64)
                gaps, squares = query_distances(pivots, v, most), float((v.astype(np.float64) ** 2).sum())
                far = np.inf if b is None or pd.isna(b) else np.sqrt(max(0.0, squares + most - 2.0 * int(b)))
                out += [(q, own, v, part, b, int(p)) for p in np.flatnonzero(gaps - radii <= far + 2e-7 * (np.sqrt(squares + most) + 1))]
            yield pd.DataFrame(out, columns=["query_id", "query_row", "vec", "home", "bound", "pivot"])

    more = (asked.join(bounds, "query_row", "left").select("query_id", "query_row", "vec", "part", "bound")
            .mapInPandas(reach, "query_id long, query_row long, vec array<long>, home long, bound string, pivot int")
            .select("*", F.explode(F.sequence(F.lit(0), F.get(cuts, F.col("pivot")) - 1)).alias("cut"))
            .withColumn("part", part_of(F.col("pivot"), F.col("cut"))).where("part <> home"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return (first.unionByName(visit(shared_table(more.select("query_id", "query_row", "vec", "part", "bound"), "pairs")))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
