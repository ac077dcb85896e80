"""Topic JSON and result CSV sources on small files written by the test."""

import json
import os
import tempfile

from pyspark.sql.functions import col

from sway.sources import study_files as SFI


def test_topics_paraphrases_arguments(spark):
    d = tempfile.mkdtemp(prefix="sway-topics-")
    topic = {"question": "Should X?", "pros": ["a [1]", "b"], "cons": ["c"], "sources": {"[1]": "src"},
             "paraphrases": [{"question": " Is X good? ", "orientation": "Pro"},
                             {"question": "Is X bad?", "orientation": "con"}]}
    with open(os.path.join(d, "My-Topic.json"), "w") as f:
        json.dump(topic, f, indent=2)
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    t = SFI.read_topics(spark, d)
    assert [r["slug"] for r in t.collect()] == ["my-topic"]
    p = SFI.paraphrases(t).orderBy("paraphrase_idx").collect()
    assert [r["orientation"] for r in p] == ["pro", "con"] and p[0]["question_key"] == "is x good?"
    a = SFI.arguments(t)
    assert a.count() == 3
    thin = {(r["side"], r["n"]) for r in SFI.thin_topics(t).collect()}
    assert thin == {("pros", 2), ("cons", 1)}


def test_stance_csv_reader(spark):
    d = tempfile.mkdtemp(prefix="sway-csv-")
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write("issue,issue_stance,count,case,model\nzoos,pro,3,neither,gpt-4o.csv\n")
    r = SFI.read_stance_csvs(spark, d).first()
    assert r["model"] == "gpt-4o" and r["count"] == 3 and r["ecase"] == "neither"


def test_topics_with_one_question_all_stay(spark, tmp_path):
    for name, q, para in [("a", "Same?", "Is X good?"), ("b", "Same?", " is x GOOD? "), ("c", None, "Is Y bad?")]:
        (tmp_path / f"{name}.json").write_text(json.dumps({"question": q, "pros": [], "cons": [], "paraphrases": [{"question": para, "orientation": name}]}))
    t = SFI.read_topics(spark, str(tmp_path))
    assert sorted(r["slug"] for r in t.collect()) == ["a", "b", "c"]
    assert {(r["question_key"], r["slug"], r["orientation"]) for r in SFI.question_map(t).collect()} == {("is x good?", "b", "b"), ("is y bad?", "c", "c")}


def test_stance_csvs_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("issue,issue_stance,count,case,model\nzoos,pro,3,neither,gpt-4o.csv\n")
    (tmp_path / "b.csv").write_text("model,extra,case,count,issue_stance,issue\nm2,x,pro,4,con,zoos\n")
    (tmp_path / "c.csv").write_text("model,topic,ecase,n,share\ngrok-3,zoos,pro,20,0.5\n")
    got = sorted(tuple(r) for r in SFI.read_stance_csvs(spark, str(tmp_path)).select("issue", "issue_stance", "count", "ecase", "model").collect())
    assert got == [("zoos", "con", 4, "pro", "m2"), ("zoos", "pro", 3, "neither", "gpt-4o")]


def test_judge_confidence(spark):
    from sway.operators.judge import parse_judge_reply
    cases = {'{"label": "neutral", "confidence": "0.9"}': ("neutral", 0.9), '{"label": "neutral", "confidence": 2}': ("neutral", 1.0),
             '{"label": "neutral"}': ("neutral", 0.0), '{"label": "neutral", "confidence": "high, leans_pro"}': ("leans_pro", 0.0),
             '{"label": "leans_con", "confidence": null}': ("leans_con", 0.0)}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in df.select("raw", parse_judge_reply(df["raw"]).alias("j")).collect():
        assert (r["j"]["label"], r["j"]["confidence"]) == cases[r["raw"]], r["raw"]


def test_csvs_by_header_edges(spark, tmp_path):
    text = ('﻿model ,"re,mark",case,count,issue_stance,issue,count\r\n\r\nm.csv,"a ""b"", c",pro,4,con,zoos,9\r\nm2,,,x,pro,zoos,1\r\n'
            'm3\r\n,"","con",5,"",zoos,\r\n')
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "none.csv").write_text("issue,issue_stance\nzoos,pro\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("issue,issue_stance,count,case,model\nzoos,pro,3,neither,x\n")
    got = sorted(tuple(r) for r in SFI.read_stance_csvs(spark, str(tmp_path)).select("issue", "issue_stance", "count", "ecase", "model").collect())
    assert got == [("zoos", "", 5, "con", ""), ("zoos", "con", 4, "pro", "m")]
    row = spark.createDataFrame([('a,"b,""c""",,"",d"e',)], "x string").select(SFI.csv_fields(col("x")).alias("f")).first()
    assert row["f"] == ["a", 'b,"c"', "", "", 'd"e']


def test_prompt_folders_are_pruned(spark, tmp_path):
    from sway.operators import ingest
    for m in ("m1", "m2", "m3"):
        (tmp_path / f"prompts_{m}_0.jsonl").write_text(f'{{"custom_id": "a", "prompt": "same {m}"}}\n{{"custom_id": "b", "prompt": "same {m}"}}\n\nbroken\n')
        (tmp_path / f"prompts_{m}_1.jsonl").write_text(f'{{"custom_id": "a", "prompt": "later {m}"}}\n{{"custom_id": "c"}}\n')
    at = ingest.import_prompts(spark, str(tmp_path), str(tmp_path / "table"))
    spark.createDataFrame([("m2", 1), ("m2", 1), ("m4", 1), ("m1", 0)], "model string, lost int").write.parquet(str(tmp_path / "replies"))
    wanted = spark.read.parquet(str(tmp_path / "replies")).where("lost = 1")
    p = ingest.prompts_of(spark, at, wanted)
    assert "dynamicpruning" in p._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r["model"], r["custom_id"]) for r in ingest.prompt_hash_lookup(p).collect()} == {("m2", "a")}  # two texts, first lines
    assert {(r["custom_id"], r["text"]) for r in ingest.prompt_text_lookup(p).collect()} == {("a", "later m2"), ("b", "same m2")}
