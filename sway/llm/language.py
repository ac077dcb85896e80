"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letter runs give subwords of one to four letters (with marks for the run's ends), each
hashed to a row of an embedding table; the average of all rows goes through a linear layer and a
softmax.  Table and layer are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows, whose subword counts the tasks take from whole texts.

More labelled rows are set aside to calibrate: a temperature makes the scores probabilities,
and the rejection threshold is set so that at most a given share of the set-aside rows falls
below it, but always above an even score.  Texts without a letter are always rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.common import prepare, shared_table

BITS, DIM, ORDERS = 16, 16, (1, 2, 3, 4)
#: Labelled rows to train on (about, and never over twice as many), the largest share of a language's
#: labelled rows set aside for calibration, and the share of these that may be rejected.
TRAIN_ROWS, ASIDE, REJECT = 3000, 0.25, 0.001
#: Labelled rows set aside (about, and never over twice as many): the share to reject is several of them.
ASIDE_ROWS = round(8 / REJECT)
#: Relative distance of the threshold from an even score, at least.
ABOVE_EVEN = 1e-6
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def subwords(text: str | None, piece: int = 1 << 20) -> np.ndarray:
    """Buckets of all subwords of the lower-cased text: of each order those that start at its first place (a space before
    the text), then the next.  A long text is taken in pieces of starting places that overlap, for memory."""
    lower = (text or "").lower()
    places = len(lower) + 2  # with a space at both ends
    found = []
    for low in range(0, places, piece):
        high = min(places, low + piece)
        part = lower[max(0, low - 1):high + max(ORDERS) - 2]
        points = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = [0] * (low == 0), [0] * (high + max(ORDERS) - 2 > len(lower))
        points = np.concatenate([ends[0], points, ends[1]]).astype(np.uint32)
        for n in ORDERS:
            count = min(high, places - n + 1) - low
            if count < 1:
                break
            value = np.full(count, n, np.uint32)
            for k in range(n):
                value = value * np.uint32(0x01000193) + points[k:k + count]
            inner = points[1:1 + count] != 0 if n > 2 else points[:count] != 0 if n == 1 else (points[:count] != 0) | (points[1:1 + count] != 0)
            if n == 4:
                inner = inner & (points[2:2 + count] != 0)
            found.append(((value[inner] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Per-bucket class scores (embedding times layer; 0 where never trained), and what calibration found."""

    languages: list[str]
    scores: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected) of a text; und and 0 without a letter."""
        buckets = subwords(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax(self.scores[buckets].mean(axis=0, dtype=np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 6, rate: float = 8.0,
          seed: int = 3) -> np.ndarray:
    """SGD over (buckets, counts, class) rows; returns per-bucket class scores.

    The layer has no bias: the sample has as many rows of each class."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, classes), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, counts, label = rows[i]
            now = np.float32(rate * (1 - done / steps))
            done += 1
            weight = (counts / counts.sum()).astype(np.float32)
            hidden = weight @ table[buckets]
            gap = softmax(hidden @ layer).astype(np.float32)
            gap[label] -= 1
            back = layer @ gap
            layer -= now * np.outer(hidden, gap)
            table[buckets] -= now * weight[:, None] * back
    # A subword that was never seen says nothing, so strange texts get an even score.
    seen = np.zeros(len(table), bool)
    for buckets, _, _ in rows:
        seen[buckets] = True
    return np.where(seen[:, None], table @ layer, 0)


def calibrate(logits: np.ndarray, labels: np.ndarray, reject: float) -> tuple[float, float]:
    """Temperature of least log loss, and a threshold that at most ``reject`` of the rows are below.

    Between two ranks it is interpolated, below the first one from the even score, which is the
    least there can be.  It is always above that, so texts that say nothing go even if more
    than ``reject`` of the rows do; with one language every score is even and 1, and none go."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 120):
        p = softmax(logits / t)[np.arange(len(labels)), labels]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    even = 1 / logits.shape[1]
    top = np.concatenate([[even], np.sort(softmax(logits / best[1]).max(axis=1))])
    at = int(reject * len(labels))
    bar = top[at] + (reject * len(labels) - at) * (top[min(at + 1, len(labels))] - top[at])
    return best[1], float(max(bar, even * (1 + ABOVE_EVEN))) if even < 1 else 1.0


def shares(sizes: dict[str, int], rows: int, aside: int) -> dict[str, tuple[float, float]]:
    """Per language the shares of its labelled rows to train on and to set aside.

    To train on are as many rows per language; set aside are ``aside`` rows in all if there are
    enough, as many per language as its rows allow.  A language of few rows sets none aside."""
    each = -(-rows // len(sizes))
    few = round(2 / ASIDE)
    # Where the rows don't suffice for both, the share set aside is ASIDE.
    train = {n: c if c <= few else min(each, c - int(ASIDE * c)) for n, c in sizes.items()}
    out, left = {}, aside
    for i, (n, c) in enumerate(sorted(sizes.items(), key=lambda x: (x[1] - train[x[0]], x[0]))):
        mine = min(c - train[n], -(-left // (len(sizes) - i)))
        left -= mine
        out[n] = (train[n] / c, mine / c)
    return out


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
        rows: int = TRAIN_ROWS, seed: int = 3, aside: int = ASIDE_ROWS) -> Model:
    """Fit on about ``rows`` of the rows that are ``usable`` and have a text and a language, as many per
    language, and calibrate on about ``aside`` others.

    The rows are picked by a hash of key and text; their number is bounded, so one task trains on them.
    The number of languages is that of the label's values, a few hundred at most."""
    spark = prepare(docs.sparkSession)
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.select(F.col(lang).alias("lang")).groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, 0)), 1.0, 0.0)
    languages, grain = sorted(sizes), 1 << 30
    code = {n: i for i, n in enumerate(languages)}
    parts = shares(sizes, rows, aside)
    bar = lambda share: F.element_at(F.create_map(*chain.from_iterable((F.lit(n), F.lit(round(share(*x) * grain))) for n, x in parts.items())), F.col("lang"))
    mark = F.pmod(F.xxhash64(key, text, F.lit(seed)), F.lit(grain))
    picked = (known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), mark.alias("mark"), F.xxhash64(key, text, F.lit(seed + 1)).alias("order"))
              .where(F.col("mark") < bar(lambda t, a: t + a)).withColumn("aside", F.col("mark") >= bar(lambda t, a: t)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.unique(subwords(t), return_counts=True) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))], names=["lang", "order", "aside", "buckets", "counts"])

    # A key and text that repeat count once.  The number picked by hash is near the bound; the limit only makes it certain.
    picked = picked.dropDuplicates(["order", "lang"])
    counted = [picked.where(which).select("text", "lang", "order", "aside").mapInArrow(
        count, "lang string, order long, aside boolean, buckets array<int>, counts array<int>").orderBy("order", "lang").limit(2 * most)
        for which, most in (("not aside", rows), ("aside", aside))]
    sample = shared_table(counted[0].unionByName(counted[1]), "sample")

    def counts_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, int]]:
        return [(b.values.to_numpy().copy(), c.values.to_numpy().astype(np.float32), code[n.as_py()])
                for n, b, c in zip(batch["lang"], batch["buckets"], batch["counts"], strict=True) if len(b)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [r for batch in batches for r in counts_of(batch)]
        if data:
            yield pa.RecordBatch.from_pydict({"scores": [train(data, len(languages), seed=seed).astype(np.float32).tobytes()]})

    def learnt(of: DataFrame) -> list:
        return of.repartition(1).sortWithinPartitions("order", "lang").mapInArrow(learn, "scores binary").collect()

    # The bounded sample trains in one task; the driver gets the model only.
    found = learnt(sample.where("not aside")) or learnt(sample)
    if not found:
        return Model([], np.zeros((1, 0)), 1.0, 0.0)
    scores = np.frombuffer(found[0]["scores"], np.float32).reshape(1 << BITS, len(languages))
    sent = spark.sparkContext.broadcast(scores)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = counts_of(batch)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[2] for r in data], pa.int32()), pa.array([(c / c.sum()) @ sent.value[b] for b, c, _ in data], pa.list_(pa.float64()))], names=["label", "logits"])

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(n.as_py(), x.values.to_numpy()) for batch in batches for n, x in zip(batch["label"], batch["logits"], strict=True)]
        if data:
            temperature, threshold = calibrate(np.array([x for _, x in data]), np.array([n for n, _ in data]), REJECT)
            yield pa.RecordBatch.from_pydict({"temperature": [temperature], "threshold": [threshold]})

    def calibrated(of: DataFrame) -> list:
        scored = of.mapInArrow(score, "label int, logits array<double>").repartition(1).sortWithinPartitions("label", "logits")
        return scored.mapInArrow(bars, "temperature double, threshold double").collect()

    bar_of = (calibrated(sample.where("aside")) or calibrated(sample))[0]
    return Model(languages, scores, bar_of["temperature"], bar_of["threshold"])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus lang_pred, score and rejected of every whole text.

    Null texts and those without a letter give und, 0 and true; nothing but the text is read for
    a prediction, so equal texts get equal ones.  Kept names must differ from the three new ones.
    The model has a fixed number of buckets, so its size is bounded."""
    spark = prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lang, score, rejected = zip(*map(m.predict, batch.column(len(keep)).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """True for rows never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))
