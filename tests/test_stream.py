"""The streaming ingest resumes from its checkpoint: a restart reads only new shards."""

import os
import uuid

from pyspark.sql import functions as F

from sway.operators import shares
from sway.plans.q_parse import _question_map
from sway.session import checkpoint_dir
from sway.sources import fixtures as fx
from sway.plans.q_stream import delivered_lines
from sway.streaming.stance_stream import latest_counts, stance_stream, write_shards


def _shard_lines(spark, sf_dir):
    return delivered_lines(spark, sf_dir)


def test_restart_picks_up_new_shards_only(spark, sf_dir):
    base = os.path.join(checkpoint_dir(spark), f"resume-{uuid.uuid4().hex}")
    inbox, out, ckpt = (os.path.join(base, x) for x in ("inbox", "counts", "_ckpt"))
    lines = _shard_lines(spark, sf_dir)
    qm = _question_map(spark, sf_dir)
    # first run: shards 0 and 1 only
    write_shards(lines.filter(F.col("shard") < 2), inbox)
    stance_stream(spark, inbox, qm, out, ckpt).awaitTermination()
    first = latest_counts(spark, out).agg(F.sum("count")).first()[0]
    # shards 2 and 3 arrive; the restarted job reads them and ends with the full counts
    for k in (2, 3):
        lines.filter(F.col("shard") == k).select("value").write.mode("overwrite").text(
            os.path.join(inbox, f"shard={k}"))
    stance_stream(spark, inbox, qm, out, ckpt).awaitTermination()
    got = latest_counts(spark, out)
    exp = shares.stance_counts(fx.trials(spark, sf_dir))
    assert 0 < first < got.agg(F.sum("count")).first()[0]
    key = ["issue", "issue_stance", "ecase", "model", "count"]
    assert got.select(*key).exceptAll(exp.select(*key)).count() == 0
    assert exp.select(*key).exceptAll(got.select(*key)).count() == 0
    # a whole shard is delivered again, in a later run: nothing is counted twice
    lines.filter(F.col("shard") == 1).select("value").write.text(os.path.join(inbox, "again"))
    stance_stream(spark, inbox, qm, out, ckpt, files_per_trigger=1).awaitTermination()
    again = latest_counts(spark, out).select(*key)
    assert again.exceptAll(exp.select(*key)).count() == 0 and again.count() == exp.count()


def test_retries_take_back_the_old_stance(spark, sf_dir, tmp_path):
    from sway.streaming.retry_stream import current_counts, retry_stream
    inbox, out, ckpt = (str(tmp_path / x) for x in ("inbox", "counts", "ckpt"))
    os.mkdir(inbox)
    qm = spark.createDataFrame([("zoos", "issue-z", None)], "question string, issue string, orientation string")
    cid = "request-zoos-%d-framing-pro-evidence-pro"

    def deliver(name, *lines):
        with open(os.path.join(inbox, name), "w") as f:
            f.write("\n".join('{"model":"m","attempt":%s,"place":%s,"custom_id":"%s","response":"%s"}' % line for line in lines) + "\nbroken {\n\n")
        retry_stream(spark, inbox, qm, out, ckpt, 1).awaitTermination()
        return {r["issue_stance"]: r["count"] for r in current_counts(spark, out).collect()}

    assert deliver("a", (0, 1, cid % 1, "position A"), (0, 2, cid % 2, "ERROR: x"), ("null", "null", cid % 3, "<<B>>")) == {"pro": 1, "other": 1, "con": 1}
    # a retry replaces the error; a second delivery of the same line and a reply before the kept one change nothing
    assert deliver("b", (1, 2, cid % 2, "position A"), (0, 1, cid % 1, "position A"), (0, 0, cid % 1, "<<B>>")) == {"pro": 2, "con": 1}
    # after the restart the state still knows the old stances; the best of several retries of one batch counts
    assert deliver("c", (1, 1, cid % 1, "<<B>>"), (2, 1, cid % 1, "none"), (0, 0, cid % 3, "<<A>>"), (0, 9, cid % 2, "<<B>>")) == {"pro": 2, "other": 1}
    assert deliver("d", (0, 1, "no id", "<<B>>")) == {"pro": 2, "other": 1}


def test_best_reply_of_a_batch_is_found_by_columns(monkeypatch):
    import random

    import pandas as pd

    from sway.streaming import retry_stream as R

    rng = random.Random(4)
    rows = [(rng.choice([None, 0, 1]), rng.choice([None, 5, 7]), rng.choice([None, "a", "é", "z", "😀"]), rng.choice([None, "i"]), "pro", rng.choice(["pro", "con"])) for _ in range(600)]
    ranked, rank = [], R._rank
    monkeypatch.setattr(R, "_rank", lambda reply: ranked.append(reply) or rank(reply))

    class State:
        exists, get = False, None

        def update(self, v):
            self.get = v

    for n in (1, 2, 7, 600):
        state = State()
        list(R.replace_reply(("m", "q"), iter([pd.DataFrame(rows[:n], columns=[*R.ORDER, *R.COUNTED])]), state))
        assert tuple(state.get) == max(rows[:n], key=rank)
    assert len(ranked) <= 8  # a batch, not a reply, is compared with the kept one
