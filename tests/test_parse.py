"""Unit tables for the reply/ID parsing expressions, including the study's quirks."""

import hashlib
import json

from pyspark.sql import functions as F

from sway.functions import parse as P


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_answer_patterns_and_quirks(spark):
    cases = {
        "position <<A>>": "A", "My answer: position B": "B", "<<a>>": "A", " B ": "B",
        "I cannot choose.": "Other", "position against it": "A",  # (?i) [A|B] matches 'a'
        "position |": "|",  # the pipe inside the class is literal
        "<<b>> and position A": "A",  # the first pattern in order wins, not the first in text
        None: "Other",
    }
    for text, exp in cases.items():
        assert _one(spark, P.answer_letter, text) == exp, text
    assert _one(spark, lambda c: P.answer_letter(c, preserve_case=True), "<<a>>") == "a"


def test_issue_stance_mapping(spark):
    df = spark.createDataFrame([("pro", "A"), ("pro", "B"), ("con", "A"), ("con", "B"), ("pro", "Other"),
                                ("pro", "|"), ("unknown", "A")], "qs string, a string")
    got = [r[0] for r in df.select(P.issue_stance(F.col("qs"), F.col("a"))).collect()]
    assert got == ["pro", "con", "con", "pro", "other", "other", "other"]


def test_custom_id_parsing(spark):
    cid = "request-should_zoos_exist-17-framing-con-evidence-75pro"
    df = spark.createDataFrame([(cid,), ("request-no-digits-framing-pro-evidence-all",), ("request-x-3-framing-pro",)],
                               "c string")
    rows = df.select(P.id_is_valid(F.col("c")), P.id_question(F.col("c")), P.id_trial(F.col("c")),
                     P.id_framing(F.col("c")), P.id_case(F.col("c"))).collect()
    assert tuple(rows[0]) == (True, "should zoos exist", 17, "con", "75pro")
    assert rows[1][0] is False and rows[2][0] is False


def test_reply_dialects_and_ids(spark):
    lines = [
        json.dumps({"custom_id": "c1", "response": "position <<A>>"}),
        json.dumps({"custom_id": "", "request": {"labels": {"custom_id": "c2"}},
                    "response": {"candidates": [{"content": {"parts": [{"text": "<<B>>"}]}}]}}),
        json.dumps({"request": {"custom_id": "c3"}, "response": {"content": [{"text": " A "}]}}),
        json.dumps({"custom_id": "c4", "response": {"choices": [{"message": {"content": "x"}}]}, "llm_answer": "B"}),
        json.dumps({"custom_id": "c5", "response": {"body": {"choices": [{"message": {"content": "position B"}}]}}}),
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(
        "value", P.parse_prediction(F.col("value")).alias("j"))
    got = df.select(P.custom_id_of(F.col("j")), P.response_text(F.col("value"), F.col("j")),
                    P.final_answer(P.response_text(F.col("value"), F.col("j")), F.col("j.llm_answer"))).collect()
    assert [tuple(r) for r in got] == [("c1", "position <<A>>", "A"), ("c2", "<<B>>", "B"), ("c3", " A ", "A"),
                                       ("c4", "x", "B"), ("c5", "position B", "B")]


def test_request_text_hash(spark):
    text = "  Some\\tPrompt\\n  TEXT  ".replace("\\t", "\t").replace("\\n", "\n")
    exp = hashlib.sha1(" ".join(text.split()).strip().lower().encode()).hexdigest()
    assert _one(spark, P.request_text_hash, text) == exp
    assert _one(spark, P.request_text_hash, "   ") is None


def test_model_from_file_and_slug(spark):
    for path, exp in [("/x/predictions_llama-3.1-405b_0.jsonl", "llama-3.1-405b"),
                      ("/x/predictions_claude-3.5-haiku.jsonl", "claude-3.5-haiku"),
                      ("/x/dir=predictions_m0_1.jsonl/part-0000.txt", "m0")]:
        assert _one(spark, P.model_from_file, path) == exp
    assert _one(spark, P.slugify, "https://example.org/topics/zoos-debate/") == "zoos"
    assert _one(spark, P.clean_text, " NaN ") == ""


def test_title_prefix_and_two_frame_merge(spark):
    from sway.operators import ingest
    assert _one(spark, P.strip_title_prefix, "### Con 2: Bad idea") == "Bad idea"
    assert _one(spark, P.strip_title_prefix, "Pro 11:  Good") == "Good"
    orig = spark.createDataFrame([("m", "a", "ERROR: x", 1), ("m", "a", "ok-a", 2), ("m", "b", "ok-b", 1), ("n", "a", "other", 1)],
                                 "model string, custom_id string, response_text string, line long")
    retry = spark.createDataFrame([("m", "a", "fixed-a", 0)], orig.schema)
    got = {(r["model"], r["custom_id"]): (r["response_text"], r["from_retry"])
           for r in ingest.merge_retries(orig, retry, order_cols=("line",)).collect()}
    assert got == {("m", "a"): ("fixed-a", True), ("m", "b"): ("ok-b", False), ("n", "a"): ("other", False)}


def test_malformed_replies_do_not_fail(spark):
    """Empty arrays and odd shapes give an empty text, as in the study."""
    lines = ['{"custom_id": "c", "response": {"choices": []}}', '{"custom_id": "c", "response": {"content": []}}',
             '{"custom_id": "c", "response": {"candidates": [{"content": {"parts": []}}]}}', '{"custom_id": "c", "response": {"body": {"choices": []}}}',
             '{"custom_id": "c", "request": {"contents": []}}', '{"custom_id": "c", "request": {"messages": []}}', '{"custom_id": "c"']
    df = spark.createDataFrame([(x,) for x in lines], "value string").select("value", P.parse_prediction(F.col("value")).alias("j"))
    got = df.select(P.response_text(F.col("value"), F.col("j")), P.request_text(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [("", "")] * len(lines)


def test_request_text_of_lists_and_prompt_text(spark):
    lines = [{"request": {"messages": [{"content": [{"type": "text", "text": "from a list"}]}]}}, {"prompt_text": "kept apart"},
             {"request": {"messages": [{"content": "[A] or [B]"}]}}, {"request": {"messages": [{"content": ""}]}, "prompt_text": "p"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    got = [r[0] for r in df.select(P.request_text(P.parse_prediction(F.col("value")))).collect()]
    assert got == ["from a list", "kept apart", "[A] or [B]", "p"]
