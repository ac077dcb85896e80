"""The auction's repairs against dynamic programming over (cost, audit), and the query against its SQL on hostile rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sway.llm import oracles, queries, repair


def added(layer):
    while True:
        new = dict(layer)
        for s, (cost, audit) in layer.items():
            to, found = repair.ADDED[s], (cost + 3, audit + "I")
            if to not in new or found < new[to]:
                new[to] = found
        if new == layer:
            return layer
        layer = new


def best(rows, entry=0, ends=None):
    """(cost, audit) of the cheapest, then least, repair of (initial, fault) rows."""
    layer = {entry: (0, "")}
    for initial, fault in rows:
        new = {}
        for s, (cost, audit) in added(layer).items():
            moves = [(s, 4, "D")]
            if fault in (0, 3):
                more = 3 if fault else 0
                moves.append((repair.ADDED[s], 3 + more, "R"))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, initial))
                moves += [(to, more, "K")] if to is not None else []
            for to, c, letter in moves:
                if to not in new or (cost + c, audit + letter) < new[to]:
                    new[to] = (cost + c, audit + letter)
        layer = new
    if ends is not None:
        return min(layer[s][0] + ends[s] for s in layer)
    return min(v for s, v in added(layer).items() if s in repair.ENDS)


def random_rows(rng, n):
    return [(rng.choice("ssuuuuaaaax"), rng.choice([0, 0, 0, 0, 1, 2, 3, 3])) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 3, 8, 64])
def test_auction_finds_the_least_repair(span, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", span)
    rng = random.Random(span)
    for _ in range(500):
        rows = random_rows(rng, rng.randrange(14))
        edits, state = repair.Lattice(rows, states=[0]).trace(0)
        assert (sum(c for _, c, _ in edits), "".join(x for x, _, _ in edits)) == best(rows)
        assert state in repair.ENDS


def test_prices_between_states():
    """Prices from every state to given ends are distances; what can't be reached stays infinite."""
    rng = random.Random(2)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(1, 12))
        for ends in ([0.0, repair.FAR, repair.FAR, repair.FAR], [repair.FAR, 0.0, repair.FAR, repair.FAR], [7.0, 3.0, 0.0, 5.0]):
            prices = repair.Lattice(rows, ends).price[0]
            for s in range(4):
                layer = added({s: (0, "")})
                try:
                    want = min(best(rows, t, ends) + c for t, (c, _) in layer.items())
                except ValueError:
                    want = repair.FAR
                assert prices[s] == want


def test_work_grows_with_the_rows():
    rng = random.Random(3)
    bids = [repair.Lattice(random_rows(rng, n), states=[0]).bids / n for n in (500, 5000)]
    assert bids[1] < 1.3 * bids[0]


ROWS = "conv_id long, turn long, role string, text string"


def hostile():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", " ", "Long " * 300 + "end.", "a:b.\nc", None, "...", "dots . "]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(9))]
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(100, 160)]  # one long conversation
    rows += [(None, t, "user", "Null conversation.") for t in range(6)] + [(90, None, "user", "Null turn."), (90, None, "assistant", "Null turn"), (90, 3, "user", "x.")]
    rows += [(91, 5, "user", "Same.")] * 40 + [(92, -2 ** 63, "user", "Far."), (92, 2 ** 63 - 3, "assistant", "Away.")]
    return rows


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(oracles.OP12).fetchall(), key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_hostile_rows_equal_sql(spark, tmp_path, monkeypatch, block):
    """Blocks of four rows exercise the conversations that are repaired in parts."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = [r for r in hostile() if r[0] != 92]  # its gap exceeds what the SQL's longs hold
    df = spark.createDataFrame(rows, ROWS).withColumns({"conv": F.lit("clash"), "block": F.lit(3), "pos": F.lit(None).cast("long"), "fault": F.lit("x")})
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in queries.op12_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == sql(rows)


def test_extreme_turns_and_empty(spark, tmp_path):
    spark.createDataFrame([r for r in hostile() if r[0] == 92], ROWS).write.parquet(str(tmp_path / "far" / "conversations.parquet"))
    (out,) = queries.op12_repair(spark, str(tmp_path / "far")).collect()
    assert out["audit"] in ("KK", "KI", "IK", "DD", "", "KR", "D") and out["gaps"] in (0, None)
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op12_repair(spark, str(tmp_path / "none")).count() == 0


def test_edits_give_the_repaired_conversation(spark):
    """The operator's own output: texts of a repaired conversation are in its edits."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "user", "Hello?"), (1, 4, "assistant", "cut off")]
    out = repair.repair(spark.createDataFrame(rows, ROWS)).orderBy("block", "step").collect()
    assert [(r["edit"], r["cost"], r["fault"], r["role"], r["text"]) for r in out] == [
        ("K", 0, "", "system", "Be kind."), ("I", 3, None, "user", ""), ("K", 0, "", "assistant", "Hi."), ("K", 0, "", "user", "Hello?"),
        ("D", 4, "duplicate", None, None), ("K", 3, "truncated", "assistant", "cut off")]
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in out if r["role"]))


def test_order_columns(spark):
    rows = [(1, None, "assistant", "B.", 2), (1, None, "user", "A.", 1)]
    out = repair.repair(spark.createDataFrame(rows, ROWS + ", seq int"), order=("seq",)).collect()
    assert [(r["edit"], r["role"]) for r in sorted(out, key=lambda r: r["step"])] == [("K", "user"), ("K", "assistant")]
