"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

The state has two tables in the shared folder.  ``refs`` counts, for every live line key, the
documents that hold it and their largest id.  ``filters`` has a cuckoo filter per shard
with the keys found in at least ``min_docs`` documents.  Inserting documents adds to the
counts, deleting subtracts; a key that crosses ``min_docs`` enters or leaves its filter, so
deleting what was inserted gives the former state back.

To rewrite documents, tasks probe the filters for each line and only the few keys that may be
frequent are joined with the exact counts, which decide.  Filters are sent to the tasks while
their total size is below a bound; beyond it every key is joined.  Results are the same.

Keys are 128-bit hashes of the normalised line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.common import prepare, shared_table

SPACE = " \t\n\x0b\x0c\r"
#: Keys of one shard's filter (on average, when the state is first filled) and the size of all
#: filters up to which tasks get them.
SHARD_KEYS, FILTER_BYTES = 1 << 20, 32 << 20
SLOTS, KICKS = 4, 500
#: Tasks that share a shard's keys where the keys go to the filters.
LANES = 4


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Key of each line of the text (null: one empty line); None for lines that are too short."""
    keys: list[bytes | None] = []
    for line in (text or "").split("\n"):
        core = line.strip(SPACE) if len(line) >= min_chars else ""
        keys.append(xxhash.xxh3_128_digest(core.encode().lower()) if len(core) >= min_chars else None)
    return keys


class CuckooFilter:
    """Approximate set of 128-bit keys with insertion and deletion; no false negatives.

    A key's 16-bit tag sits in one of two buckets; either bucket follows from the other and the
    tag.  Deleting a key that is in the set never hurts another one."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < max(keys, 1):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags and both buckets of keys given as two arrays of uint64."""
        mask = np.uint64(len(self.slots) - 1)
        tag = (lo >> np.uint64(48)) | np.uint64(1)
        first = hi & mask
        return tag, first, first ^ (tag * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & mask

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        tag, first, second = self.places(hi, lo)
        return ((self.slots[first] == tag[:, None]) | (self.slots[second] == tag[:, None])).any(axis=1)

    def _swap(self, bucket: int, old: int, new: int) -> bool:
        row = self.slots[bucket]
        at = np.flatnonzero(row == old)
        if len(at):
            row[at[0]] = new
        return bool(len(at))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add keys that are not in the set; False if the filter is too full (then rebuild it)."""
        mask = len(self.slots) - 1
        for tag, a, b in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            if self._swap(a, 0, tag) or self._swap(b, 0, tag):
                continue
            at = b
            for kick in range(KICKS):
                out = int(self.slots[at, kick % SLOTS])
                self.slots[at, kick % SLOTS] = tag
                tag = out
                at ^= (tag * 0x9E3779B97F4A7C15 % 2 ** 64 >> 17) & mask
                if self._swap(at, 0, tag):
                    break
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for tag, a, b in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            if not self._swap(a, tag, 0):
                self._swap(b, tag, 0)


@dataclass(frozen=True)
class LineIndex:
    """State of the dedup; ``insert`` and ``delete`` return a new one.

    A row is a document: an id in several rows counts as often, and the largest id keeps its lines in
    each of them.  A null id counts as a document and as the smallest id."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, shards: int = 0) -> LineIndex:
        prepare(spark)
        return cls(spark.createDataFrame([], "hi long, lo long, n_docs long, top_id long"),
                   spark.createDataFrame([], "shard int, slots binary"), shards, min_chars, min_docs)

    def _postings(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(doc_id, hi, lo): the distinct keys of each row."""
        return _keys_of(docs, key, text, self.min_chars, lambda hi, lo: np.ones(len(hi), bool))

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        new = self._postings(docs, key, text).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_id"))
        refs = (self.refs.withColumn("was", F.col("n_docs")).unionByName(new.withColumn("was", F.lit(0).cast("long")))
                .groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("top_id").alias("top_id"), F.sum("was").alias("was")))
        return self._next(refs)

    def delete(self, docs: DataFrame, remaining: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Remove inserted documents; ``remaining`` are those that stay (read for keys that lose their largest id)."""
        gone = (self._postings(docs, key, text).groupBy("hi", "lo")
                .agg(F.count("*").alias("n_gone"), F.max("doc_id").alias("top_gone")))
        left = shared_table(self.refs.withColumn("was", F.col("n_docs")).join(gone, ["hi", "lo"], "left")
                            .withColumn("n_docs", F.col("n_docs") - F.coalesce("n_gone", F.lit(0)))
                            .withColumn("stale", F.col("top_id").eqNullSafe(F.col("top_gone"))), "left")
        stale = left.where("stale and n_docs > 0").select("hi", "lo")
        tops = (self._postings(remaining, key, text).join(stale, ["hi", "lo"], "left_semi")
                .groupBy("hi", "lo").agg(F.max("doc_id").alias("top_left")))
        refs = (left.join(tops, ["hi", "lo"], "left")
                .withColumn("top_id", F.when(F.col("stale"), F.col("top_left")).otherwise(F.col("top_id"))))
        return self._next(refs)

    def _next(self, refs: DataFrame) -> LineIndex:
        refs = shared_table(refs.select("hi", "lo", "n_docs", "top_id", "was"), "refs")
        often = (F.col("n_docs") >= self.min_docs)
        known = F.col("was") >= self.min_docs
        needed = max(1, -(-refs.where(often).count() // SHARD_KEYS))
        # An index that has outgrown its shards by twice is dealt to more; all frequent keys are inserted anew.
        grown = needed > 2 * (self.shards or needed)
        shards = needed if grown or not self.shards else self.shards
        if grown:
            known = F.lit(False)
        filters = self.filters.limit(0) if grown else self.filters
        changes = (refs.where(often | known)
                   .select(F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), "hi", "lo",
                           often.cast("int").alias("now"), known.cast("int").alias("before")))

        def update(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            hi, lo = (keys[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
            now, before = keys["now"].to_numpy() == 1, keys["before"].to_numpy() == 1
            shard = int((old if len(old) else keys)["shard"].iloc[0])
            filt = CuckooFilter.read(old["slots"].iloc[0]) if len(old) else CuckooFilter.sized(int(now.sum()))
            filt.delete(hi[before & ~now], lo[before & ~now])
            size = int(now.sum())
            if not filt.insert(hi[now & ~before], lo[now & ~before]):
                while not (filt := CuckooFilter.sized(size)).insert(hi[now], lo[now]):
                    size *= 2
            return pd.DataFrame({"shard": [shard], "slots": [filt.slots.tobytes()]})

        filters = (filters.groupBy("shard").cogroup(changes.groupBy("shard"))
                   .applyInPandas(update, "shard int, slots binary"))
        return LineIndex(refs.where("n_docs > 0").drop("was"), shared_table(filters, "filters"), shards,
                         self.min_chars, self.min_docs)

    def _passing(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(doc_id, hi, lo): the distinct keys of each row that the filters hold.

        Small filters go to the tasks that read the texts.  Beyond FILTER_BYTES the keys go to the filters: each
        (shard, lane) gets its filter first and then its keys, one after the other, so a task holds one filter; lanes
        split the keys of a line that very many documents hold."""
        size = self.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
        shards = self.shards
        if size <= FILTER_BYTES:
            sent = self.filters.sparkSession.sparkContext.broadcast({r["shard"]: r["slots"] for r in self.filters.collect()})

            def test(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
                found, at = np.zeros(len(hi), bool), lo.view(np.int64) % shards
                for shard, data in sent.value.items():
                    mine = np.flatnonzero(at == shard)
                    if len(mine):
                        found[mine] = CuckooFilter.read(data).holds(hi[mine], lo[mine])
                return found

            return _keys_of(docs, key, text, self.min_chars, test)
        every = self._postings(docs, key, text)
        lane = F.pmod(F.xxhash64("doc_id", "hi"), F.lit(LANES)).cast("int")
        asked = every.select("doc_id", "hi", "lo", F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), lane.alias("lane"), F.lit(None).cast("binary").alias("slots"))
        blank = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("doc_id", "hi", "lo")]
        holders = self.filters.select(*blank, "shard", F.explode(F.array(*[F.lit(i) for i in range(LANES)])).alias("lane"), "slots")
        both = holders.unionByName(asked).repartition("shard", "lane").sortWithinPartitions("shard", "lane", F.col("slots").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, filt = None, None
            for batch in batches:
                place = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if at != tuple(place[a]):
                        at, filt = tuple(place[a]), None
                    part = batch.slice(a, b - a)
                    heads = np.flatnonzero(part.column(5).is_valid().to_numpy(zero_copy_only=False))
                    if len(heads):  # the first row of a (shard, lane)
                        filt = CuckooFilter.read(part.column(5)[int(heads[0])].as_py())
                        part = part.slice(int(heads[-1]) + 1)
                    if filt is not None and part.num_rows:
                        hi, lo = (part.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (1, 2))
                        ok = np.flatnonzero(filt.holds(hi, lo))
                        yield part.select(["doc_id", "hi", "lo"]).take(pa.array(ok))

        return both.mapInArrow(run, every.schema)

    def drops(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses, for those that lose any."""
        often = self.refs.where(F.col("n_docs") >= self.min_docs)
        return (self._passing(docs, key, text).join(often, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("top_id")))
                .groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys")))

    def rewrite(self, docs: DataFrame, key: str = "doc_id", text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns, the kept text under ``text``'s name, __n_lines and __n_dropped of every row."""
        keep = [key] if keep is None else keep
        drops = shared_table(self.drops(docs, key, text), "drops").withColumnRenamed("doc_id", "__id")
        min_chars = self.min_chars
        schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField(text, T.StringType()),
                               T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts, dropped = [], [], []
                for body, gone in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                    lines = (body or "").split("\n")
                    counts.append(len(lines))
                    if gone:
                        bad = {_digest(k["hi"], k["lo"]) for k in gone}
                        lines = [x for x, k in zip(lines, line_keys(body, min_chars), strict=True) if k not in bad]
                    dropped.append(counts[-1] - len(lines))
                    texts.append("\n".join(lines))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

        joined = docs.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
        # The drops grow with the documents: never broadcast, and the texts need no sort.
        joined = joined.join(drops.hint("shuffle_hash"), F.col("__key").eqNullSafe(F.col("__id")), "left")
        return joined.select(*[f"__keep{i}" for i in range(len(keep))], "__text", "keys").mapInArrow(run, schema)


def _digest(hi: int, lo: int) -> bytes:
    return np.array([hi, lo], ">i8").tobytes()


def _keys_of(docs: DataFrame, key: str, text: str, min_chars: int,
             test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, hi, lo) of each row's distinct keys that pass the test."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set(line_keys(t, min_chars)) - {None} for t in batch.column(1).to_pylist()]
            keys = np.frombuffer(b"".join(k for s in sets for k in s), ">u8").astype(np.uint64).reshape(-1, 2)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            hi, lo = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
            ok = test(hi, lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[ok])), pa.array(hi[ok].view(np.int64)), pa.array(lo[ok].view(np.int64))], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """Rewrite all documents against an index of themselves (see ``LineIndex.rewrite``).

    A null or empty text is one empty line and stays an empty text; a text that loses all its lines
    becomes empty; other columns than ``keep`` are not read."""
    index = LineIndex.empty(docs.sparkSession, min_chars, min_docs).insert(docs, key, text)
    return index.rewrite(docs, key, text, keep)
