"""Incremental ingest of prediction shards into stance counts (Structured Streaming).

New JSONL shards dropped into a folder are parsed with the same column expressions as the
batch path.  A reply counts once however often and however late it is delivered again: the
state keeps every (model, request id) seen, with no time limit, so it grows with the
requests (RocksDB keeps it on disk).  Stance counts are a complete aggregate; each
micro-batch writes them to a folder of its own, and readers take the newest finished one, so a
failure in between loses nothing.  The checkpoint makes the job resume where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.operators import ingest
from sway.session import checkpoint_dir

LINE_SCHEMA = "value string"


def write_shards(lines: DataFrame, folder: str) -> str:
    """Write (value, shard) lines as JSON text shards, one folder per shard, in one pass."""
    lines.select("value", "shard").write.mode("overwrite").partitionBy("shard").text(folder)
    return folder


def stance_stream(spark: SparkSession, inbox: str, question_map: DataFrame, out_path: str,
                  ckpt: str, files_per_trigger: int = 1000):
    """Start the streaming job; returns the StreamingQuery (trigger availableNow, at most
    ``files_per_trigger`` shards in a micro-batch)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    raw = (spark.readStream.schema(LINE_SCHEMA).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files_per_trigger).text(inbox)
           .select(F.trim("value").alias("value"))
           .filter((F.length("value") > 0) & ~F.col("value").startswith(ingest.LFS_PREFIX)))
    raw = raw.select("value", F.get_json_object("value", "$.model").alias("model"))
    dec = ingest.decode_predictions(raw)
    parsed = ingest.parsed_ids(dec)
    trials = ingest.enrich_trials(parsed, question_map, stance_from="framing")
    deduped = trials.dropDuplicates(list(ingest.REPLY_KEY))
    counts = (deduped.filter(F.col("issue") != "unknown")
              .groupBy("issue", "issue_stance", "ecase", "model").agg(F.count(F.lit(1)).alias("count")))

    def upsert(batch: DataFrame, epoch: int) -> None:
        # complete mode: each batch carries the whole (bounded) aggregate; a repeated epoch writes the same
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch:09d}")

    return (counts.writeStream.outputMode("complete").foreachBatch(upsert)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The counts of the newest micro-batch that was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_path}/epoch=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return spark.read.parquet(max(str(f.getPath().getParent()) for f in found))


def run_stance_stream(spark: SparkSession, lines: DataFrame, question_map: DataFrame) -> DataFrame:
    """Write shards, drain them through the stream, return the resulting counts table."""
    base = os.path.join(checkpoint_dir(spark), f"stance-stream-{uuid.uuid4().hex}")
    inbox, out, ckpt = (os.path.join(base, x) for x in ("inbox", "counts", "_checkpoint"))
    write_shards(lines, inbox)
    q = stance_stream(spark, inbox, question_map, out, ckpt)
    q.awaitTermination()
    return latest_counts(spark, out)
