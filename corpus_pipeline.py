"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of ``documents``;
extra columns travel along.  Empty tables give empty results; null texts have no letter and go
in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.llm import bpe, language, line_dedup, mixing, simhash
from sway.llm.common import shared_table, table
from sway.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, mix_domain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the model rejects; learn from those not held out."""
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    rows = docs.select(F.struct("*").alias("__row"), "text")
    return language.predict(rows, model, keep=["__row"]).where("not rejected").select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop long lines that at least five documents share, but in the largest id; n_chars follows."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5, keep=[c for c in docs.columns if c != "text"])
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component: the smallest id, nulls last, ties by a hash of the row."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]  # Spark hashes no maps
    row_hash = F.xxhash64(*hashed, *[F.col(c).isNull() for c in hashed])
    # The row travels as one column, so its own names can't clash with those added here.
    marked = docs.select(F.struct("*").alias("__row"), "doc_id", "text", row_hash.alias("__row_hash"))
    found = simhash.rooted_rows(marked, words=4, radius=4, keep=("__row_hash",))
    counted = found.groupBy("root", "doc_id", "__row_hash").count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row_hash", "count")).alias("first")
    kept = shared_table(counted.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("__id"), F.col("first.__row_hash").alias("__first"), F.col("first.count").alias("__copies")), "near")
    # The list grows with the documents: never broadcast.
    rows = marked.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__first")), "left_semi")
    if kept.where("__copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "__row_hash"])
    return rows.select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, mixed to the weights; a document comes once per epoch."""
    return mixing.mix(docs, mix_domain(), MIX_WEIGHTS, 1.0, MIX_EPOCHS, MIX_SEED).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, round_trip) of every row."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(rows, keep=["doc_id", "lang", "source", "text"], decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                        (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near),
          ("mixing", mix_sources), ("bpe", encode)]

#: Language ID, SimHash and BPE can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
