"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared by exclusive-or and bit counts in numpy, block against block and,
inside, tile against tile.  The bit counts of two fingerprints within the radius differ by
no more than the radius, and so does the sum of the differences over any parts of them.
Blocks hold fingerprints of equal bit counts of the two halves; pairs of blocks beyond the
radius are never formed.  Tiles are cut after sorting by the bit counts of the four
quarters; pairs of tiles whose count ranges are further apart than the radius are skipped.
All other pairs are compared, so no link is lost.

Only distinct fingerprints are compared.  A block pair reports, for its own links, a forest
that joins the same fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.common import prepare, shared_table, shuffle_partitions
from sway.llm.components import components

SEED = 42
#: Fingerprints in a block at most (on average, where a class is cut by hash) and in a tile.
BLOCK, TILE = 8192, 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the text's word shingles; words are cut at ASCII white space, A-Z lower-cased.

    Fewer words than a shingle form one shingle; no word gives 0."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1:].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep`` columns, fp) of every row; fp holds the 64 bits as a signed long."""
    prepare(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", df.schema[key].dataType), *(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(F.col(key), *keep, F.col(text)).mapInArrow(run, schema)


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit quarters of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in left, in right) of all pairs within the radius, a few tiles at a time."""
    def tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = quarter_counts(fps)
        order = np.lexsort(counts.T)
        cuts = np.arange(0, len(fps), TILE)
        return order, np.minimum.reduceat(counts[order], cuts), np.maximum.reduceat(counts[order], cuts)

    (a, a_low, a_high), (b, b_low, b_high) = tiles(left), tiles(right)
    for i in range(len(a_low)):
        apart = np.maximum(0, np.maximum(b_low - a_high[i], a_low[i] - b_high)).sum(axis=1)
        rows = a[i * TILE:(i + 1) * TILE]
        for j in np.flatnonzero(apart <= radius):
            columns = b[j * TILE:(j + 1) * TILE]
            bits = np.bitwise_count(left[rows][:, None] ^ right[columns][None, :])
            x, y = np.nonzero(bits <= radius)
            if len(x):
                yield rows[x], columns[y]


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, smallest fingerprint it is joined with) of the links of two blocks."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = np.arange(len(nodes))

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for x, y in links(left, right, radius):
        p, q = at[x], at[len(left) + y]
        while (root[root] != root).any():
            root = root[root]
        open_ = root[p] != root[q]
        for m, n in zip(root[p][open_].tolist(), root[q][open_].tolist(), strict=True):
            m, n = find(m), find(n)
            if m != n:
                root[max(m, n)] = min(m, n)
    while (root[root] != root).any():
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[root[moved]].tolist(), strict=True))


def _near(radius: int) -> list[tuple[int, int]]:
    """Differences of the halves' bit counts within the radius, one of each opposite two."""
    return [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)
            if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]


def link_forest(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) edges that join exactly the distinct fingerprints ``fp`` linked within the radius."""
    halves = distinct.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    # At most 33 * 33 classes, whatever the input; large classes are cut by a hash.
    sizes = {(r["high"], r["low"]): -(-r["count"] // BLOCK) for r in halves.groupBy("high", "low").count().collect()}
    cuts = F.lit([sizes.get((h, w), 0) for h in range(33) for w in range(33)])
    cuts_of = lambda high, low: F.get(cuts, high * 33 + low)
    blocks = shared_table(
        halves.withColumn("part", F.pmod(F.xxhash64("fp"), cuts_of(F.col("high"), F.col("low"))).cast("int"))
        .groupBy("high", "low", "part").agg(F.collect_list("fp").alias("fps")), "blocks")
    steps = F.array(*[F.struct(F.lit(x).alias("dh"), F.lit(y).alias("dl")) for x, y in _near(radius)])
    first = (blocks.select("high", "low", F.col("part").alias("own"), F.col("fps").alias("left"), F.explode(steps).alias("d"))
             .select("own", "left", "d", (F.col("high") + F.col("d.dh")).alias("high"), (F.col("low") + F.col("d.dl")).alias("low"))
             .where(F.col("high").between(0, 32) & F.col("low").between(0, 32)))
    same = (F.col("d.dh") == 0) & (F.col("d.dl") == 0)
    # Of a class with itself each two parts meet once.
    first = (first.where(cuts_of(F.col("high"), F.col("low")) > 0)
             .select("left", "high", "low", F.explode(F.sequence(
                 F.when(same, F.col("own")).otherwise(0), (cuts_of(F.col("high"), F.col("low")) - 1).cast("int"))).alias("part")))
    pairs = first.join(blocks, ["high", "low", "part"]).select("left", F.col("fps").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                a, b = (c[row].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in lists)
                edges = np.array(forest(a, b, radius), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                    radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest key reachable, itself included.  Null and wordless texts have fingerprint 0 and
    are linked like any other; rows that repeat a key keep a row each; null keys are never a
    component's id (null if there is no other); other columns are not read."""
    return rooted_rows(df, key, text, words, radius).select("doc_id", "fp", "component_id")


def rooted_rows(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep`` columns, fp, root, component_id) of every row, as ``near_duplicates``.

    root is a fingerprint that names the component, whether or not it has an id."""
    found = shared_table(fingerprints(df, key, text, words, keep), "fingerprints")
    classes = shared_table(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(link_forest(classes.select("fp"), radius))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = shared_table(rooted.join(smallest, "root").select("fp", "root", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", *keep, "fp", "root", "component_id")
