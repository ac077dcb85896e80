"""Stance counts of a stream in which retries replace earlier replies.

The state keeps, for each (model, request id), the reply that counts so far: the one of the highest
(attempt, place), wherever in the stream it arrives.  When a better one arrives the operator emits minus one for the
old stance and plus one for the new, so counts need no look back.  Each micro-batch adds its changes to the totals of
the one before and writes them to a folder of its own; a batch that runs again after a failure starts from the same totals
and writes the same ones.  State grows with the requests (RocksDB keeps it on disk); a key holds one reply however many
arrive, and replies of a hot key are streamed through its task in Arrow batches.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sway.operators import ingest
from sway.session import checkpoint_dir
from sway.streaming.stance_stream import LINE_SCHEMA, write_shards

CELL = ("issue", "issue_stance", "ecase", "model")
CHANGE_SCHEMA = "model string, issue string, ecase string, issue_stance string, change long"
# The order of a key's replies, then what is counted of them; nulls sort first as in ``max_by`` over a struct.
STATE_SCHEMA = "attempt long, place long, response_text string, issue string, ecase string, issue_stance string"
ORDER = ("attempt", "place", "response_text")
COUNTED = ("issue", "ecase", "issue_stance")


def _rank(reply: tuple) -> tuple:
    """Sort key of a reply's order columns: null before any value, texts by their UTF-8 bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in reply[:len(ORDER)])


def _top(batch: pd.DataFrame) -> tuple | None:
    """Best reply of a batch: column by column only the rows that tie so far are looked at."""
    for c in ORDER:
        if batch[c].notna().any():
            batch = batch[batch[c].notna()]
            if c != "response_text":
                batch = batch[batch[c] == batch[c].max()]
            else:
                distinct = batch[c].unique()
                batch = batch[batch[c] == max(distinct, key=str.encode)]
    for row in batch[[*ORDER, *COUNTED]].astype(object).itertuples(index=False, name=None):
        row = tuple(None if pd.isna(v) else v for v in row)
        return (*(int(v) if v is not None else None for v in row[:2]), *row[2:])
    return None


def replace_reply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the best reply of one (model, request id); emit what its replacement changes."""
    old = tuple(state.get) if state.exists else None
    best = old
    for batch in batches:
        reply = _top(batch)
        if reply is not None and (best is None or _rank(reply) > _rank(best)):
            best = reply
    if best is None or best == old:
        return
    state.update(best)
    cells = [(old, -1), (best, 1)] if old is not None else [(best, 1)]
    if old is None or old[len(ORDER):] != best[len(ORDER):]:
        yield pd.DataFrame([(key[0], *reply[len(ORDER):], change) for reply, change in cells],
                           columns=["model", *COUNTED, "change"])


def totals_path(out: str, epoch: int) -> str:
    return f"{out}/epoch={epoch:09d}"


def _finished(spark: SparkSession, out: str, before: int | None = None) -> str | None:
    """Folder of the newest micro-batch (before ``before``) that was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/epoch=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(str(f.getPath().getParent()) for f in found or [])
    names = [n for n in names if before is None or int(n.rsplit("=", 1)[1]) < before]
    return names[-1] if names else None


def retry_stream(spark: SparkSession, inbox: str, question_map: DataFrame, out: str, ckpt: str, files_per_trigger: int = 1000):
    """Start the job over JSON lines {model, attempt, place, ...reply}; returns the StreamingQuery (availableNow).

    Lines that are blank, pointers, no JSON, or without a valid id or model are left out.  A null attempt or place comes
    before any other.  Replies to unknown topics replace earlier ones but aren't counted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    raw = (spark.readStream.schema(LINE_SCHEMA).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files_per_trigger).text(inbox).select(F.trim("value").alias("value"))
           .filter((F.length("value") > 0) & ~F.col("value").startswith(ingest.LFS_PREFIX)))
    head = F.from_json("value", "model string, attempt long, place long")
    raw = raw.select("value", head.alias("h")).select("value", "h.*").filter(F.col("model").isNotNull())
    trials = ingest.enrich_trials(ingest.parsed_ids(ingest.decode_predictions(raw)), question_map, stance_from="framing")
    replies = trials.select(*ingest.REPLY_KEY, *ORDER, *COUNTED)
    changes = replies.groupBy(*ingest.REPLY_KEY).applyInPandasWithState(
        replace_reply, CHANGE_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        delta = batch.filter(F.col("issue") != "unknown").select(*CELL, "change")
        last = _finished(session, out, epoch)
        if last is not None:
            delta = delta.unionByName(session.read.parquet(last).select(*CELL, F.col("count").alias("change")))
        totals = delta.groupBy(*CELL).agg(F.sum("change").alias("count"))
        totals.filter(F.col("count") != 0).write.mode("overwrite").parquet(totals_path(out, epoch))

    return (changes.writeStream.outputMode("update").foreachBatch(add)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """The totals of the newest finished micro-batch."""
    return spark.read.parquet(_finished(spark, out)).select(*CELL, "count")


def run_retry_stream(spark: SparkSession, lines: DataFrame, question_map: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """Write (value, shard) lines as shards, drain them through the stream, return the counts."""
    base = os.path.join(checkpoint_dir(spark), f"retry-stream-{uuid.uuid4().hex}")
    inbox, out, ckpt = (os.path.join(base, x) for x in ("inbox", "counts", "_checkpoint"))
    write_shards(lines, inbox)
    retry_stream(spark, inbox, question_map, out, ckpt, files_per_trigger).awaitTermination()
    return current_counts(spark, out)
