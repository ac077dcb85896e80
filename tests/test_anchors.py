"""Anchors lose no substring; the package reaches workers that run elsewhere."""

import os
import random
import subprocess
import sys

import pytest

from sway.functions.anchors import SHORTEST, text_anchors
from sway.operators import order

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_substring_shares_its_first_anchor():
    rng = random.Random(0)
    for alphabet in ("ab", "abcdefgh é漢🙂\n", "a"):
        text = "".join(rng.choice(alphabet) for _ in range(400))
        found = set(text_anchors(text).tolist())
        for _ in range(300):
            i = rng.randrange(len(text) - SHORTEST)
            probe = text[i:i + rng.randrange(SHORTEST, 51)]
            first = text_anchors(probe[:SHORTEST])
            assert len(first) == 1 and first[0] in found
    assert len(text_anchors("x" * (SHORTEST - 1))) == len(text_anchors(None)) == 0


def test_last_argument_inside_lines_and_by_the_middle(spark):
    body = "Some words before the long argument that goes on and on, with a middle part no other text has, until it ends here."
    args = spark.createDataFrame([("t", "pro", 1, "first line\n" + body), ("t", "con", 2, "Entirely different words fill this other argument."), ("u", "con", 3, body)],
                                 "topic string, side string, doc_id long, text string")
    shown = {1: body[12:70], 2: "ZZZZ other opening " + body[19:], 3: "no such text anywhere in the arguments", 4: "Entirely different words fill this[3] other argument."}
    prompts = spark.createDataFrame([(i, "t", f"x\nCitations:\n---\n{s}\nCitations: [1]") for i, s in shown.items()], "prompt_id long, topic string, text string")
    got = {r["prompt_id"]: r["last_argument"] for r in order.last_argument(prompts, args).collect()}
    assert got == {1: "pro", 2: "pro", 4: "con"}


def test_workers_find_the_package_from_another_folder(tmp_path, sf_dir):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from sway.session import build_session
print("rows", e.queries()["page_topics"](build_session("local[2]", 4), {sf_dir!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-1500:]


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from sway import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None),
                           sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake)


def test_passages_hold_every_probe_at_its_offset():
    from sway.functions import anchors as A

    rng = random.Random(1)
    for alphabet in ("ab", "abcdefgh é漢🙂\n"):
        text = "".join(rng.choice(alphabet) for _ in range(400))
        found = A.passages(text)
        for _ in range(300):
            i = rng.randrange(len(text) - SHORTEST)
            probe = text[i:i + rng.randrange(SHORTEST, 51)]
            gram, anchor, offset = A.probe_anchor([probe])[0]
            assert any(g == gram and a == anchor and lead >= offset and p[lead - offset:][:len(probe)] == probe for g, a, p, lead in found)


def test_candidates_of_a_probe_do_not_grow_with_texts_that_share_a_phrase(spark):
    """Lines that share 30 characters and then differ: each is its own candidate only."""
    from sway.functions import anchors as A

    same = "every line opens with the same "
    rng = random.Random(2)
    lines = [same + "".join(rng.choice("bcdfgh") for _ in range(60)) for _ in range(40)]
    keys = [{(g, a) for g, a, _, _ in A.passages(x)} for x in lines]
    assert sum((A.probe_anchor([x[:50]])[0][:2] in k) for x in lines for k in keys) <= 2 * len(lines)
    args = spark.createDataFrame([("t", "pro" if i % 2 else "con", i, x) for i, x in enumerate(lines)], "topic string, side string, doc_id long, text string")
    prompts = spark.createDataFrame([(i, "t", f"x\nCitations:\n---\n{x}\nCitations: [1]") for i, x in enumerate(lines)], "prompt_id long, topic string, text string")
    got = {r["prompt_id"]: r["last_argument"] for r in order.last_argument(prompts, args).collect()}
    assert got == {i: "pro" if i % 2 else "con" for i in range(40)}


def _prompt(lines):
    return "x\nCitations:\n---\n" + "\n".join(lines) + "\nCitations: [1]"


def test_higher_lines_are_searched_only_where_lower_ones_decide_nothing(spark, monkeypatch):
    rng = random.Random(3)
    texts = [["".join(rng.choice("abcdefgh ijkl") for _ in range(80)).replace(" ", "_") for _ in range(6)] for _ in range(12)]
    args = spark.createDataFrame([("t", "pro" if i % 2 else "con", i, "\n".join(x)) for i, x in enumerate(texts)], "topic string, side string, doc_id long, text string")
    rows = [(i, "t", _prompt(x)) for i, x in enumerate(texts)] + [(50, "t", _prompt([*texts[0][:3], "~" * 60, "~" * 60]))]
    # two prompts of one id: the lowest line of one lies higher than a found line of the other
    rows += [(60, "t", _prompt([texts[1][0], "short", "short"])), (60, "t", _prompt([texts[2][0], "!" * 60]))]
    searched = []
    seen = order.text_passages
    monkeypatch.setattr(order, "text_passages", lambda c, wanted: searched.append({r["probe"] for r in wanted.collect()}) or seen(c, wanted))
    out = order.last_argument(spark.createDataFrame(rows, "prompt_id long, topic string, text string"), args)
    assert {r["prompt_id"]: r["last_argument"] for r in out.collect()} == {i: "pro" if i % 2 else "con" for i in range(12)} | {50: "con", 60: "con"}
    assert len(searched) == 2 and all(x[-1][:50] in searched[0] for x in texts)
    assert searched[1] == {p for x in texts[0][:3] for p in (x[:50], x[40:])} | {"~" * 50, "~" * 30} | {p for p in (texts[2][0][:50], texts[2][0][40:])}


def test_few_unwanted_anchors_pass_however_many_are_wanted(spark):
    from pyspark.sql import functions as F

    from sway.functions import anchors as A

    def share(n):  # of other anchors that pass a map of n
        held = A.wanted_bits(spark.range(n).select(F.xxhash64("id").alias("anchor")))
        some = [r["a"] for r in spark.range(n, n + 20_000).select(F.xxhash64("id").alias("a")).collect()]
        at = [[((a % (1 << 64)) >> s) & (len(held) * 8 - 1) for s in (0, A.HIGH)] for a in some]
        return sum(all(int(held[x >> 3]) >> (x & 7) & 1 for x in pair) for pair in at) / len(some)
    assert share(20_000) < 0.01 and share(200_000) < 0.01
    assert A.bits_for(1) == A.LEAST_BITS and A.bits_for(7_000_000) > 16 * 7_000_000 and A.bits_for(1 << 40) == A.MOST_BITS


def test_shuffle_files_of_a_written_step_are_gone(spark):
    from sway.session import materialize

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {x for x in blocks.split() if x.startswith("shuffle_")}
    before = files()
    df = materialize(spark.range(5000).repartition(7, "id").groupBy("id").count(), tidy=True)
    assert df.count() == 5000 and df.groupBy("count").count().collect()[0][1] == 5000
    assert len({x.split("_")[1] for x in files() - before}) <= 2  # of the two queries on what was written only


def test_documents_beside_the_ones_before(spark):
    from sway.plans.q_order import with_earlier

    ids = [None, None, -33, -32, -31, -1, 0, 1, 1, 2, 2, 31, 32, 33, 64, 95, 96, 97, 200]
    rows = [(i, f"s{k}", None if k == 9 else f"text {k}") for k, i in enumerate(ids)]
    want = [(i, s, t, e) for i, s, t in rows for e in ([u for j, _, u in rows if None not in (i, j) and j == i - 1] or [None])]
    got = with_earlier(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted(map(repr, map(tuple, got.select("doc_id", "source", "text", "earlier").collect()))) == sorted(map(repr, want))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
