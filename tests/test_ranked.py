"""Blocks ranked in one order of a session: the boosts of the operators that find them by joins, and plans that read a session once."""

import random

from pyspark.sql import functions as F

from logloom.operators import blocks as B
from logloom.operators import brief, many, summary
from logloom.sources import messages as M

ROW = "session_id string, source long, blk long, kind string, text string, name string, path string, command string, args variant, exit_code int"


def odd_blocks(spark):
    r = random.Random(7)
    rows = []
    for s in ("a", "b", "c", "d"):
        at = 0
        for i in range({"a": 300, "b": 40, "c": 1, "d": 12}[s]):
            at += r.choice([1, 1, 1, 2, 5])
            kind = r.choice(["user", "assistant", "assistant", "bash", "tool_call", "tool_result", "custom", "thinking"])
            text = r.choice([None, "", " x ", "word " * 40, "fails " * 260]) if kind != "tool_call" else None
            command = r.choice(["ls -la", "npm test", "cd /x\npwd", "git commit -m x", "cat <<EOF\nls\nEOF\nmake", "cat <<EOF\nls", ""]) if kind in ("bash", "tool_call") else None
            rows.append((s, i, at, kind, text, r.choice(["edit", "read", "bash", "x"]) if kind in ("tool_call", "tool_result") else None, "/a/b.py" if kind == "tool_call" else None, command, None, r.choice([0, 1, None]) if kind == "bash" else None))
    return spark.createDataFrame([r[:8] + r[9:] for r in rows], ROW.replace("args variant, ", "")).withColumn("args", F.try_parse_json(F.lit("{}")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boosts_are_those_of_the_joins(spark):
    b = odd_blocks(spark).cache()
    scored = B.scores(b).cache()
    boost = {(r.session_id, r.blk): r.boost for r in B.adjacency(scored).collect()}
    kinds = {}
    for r in b.orderBy("session_id", "blk").collect():
        kinds.setdefault(r.session_id, []).append(r)
    closes = set()
    for s, rows in kinds.items():
        for i, r in enumerate(rows):
            after = next((x.kind for x in rows[i + 1 :] if x.kind != "tool_result"), None)
            if r.kind == "assistant" and len((r.text or "").strip()) >= 120 and after in (None, "user"):
                closes.add((s, r.blk))
    assert {(r.session_id, r.blk) for r in B.closing(b).collect()} == closes and closes
    want = {(r.session_id, r.blk): r.score + boost.get((r.session_id, r.blk), 0) + 14 * ((r.session_id, r.blk) in closes) for r in scored.collect()}
    assert {(r.session_id, r.blk): r.score for r in B.ranked(b).collect()} == want and boost


def test_a_session_is_read_once(spark):
    b = odd_blocks(spark)
    for df in (B.ranked(b), brief.selected(b), B.closing(b), brief.with_closing(b)):
        assert "Join" not in plan(df) and "rowframe, 1, unboundedfollowing" not in plan(df).lower()


def test_texts_are_read_once(spark):
    rows = spark.createDataFrame([("s", i, '{"role":"user","content":"fix step %d"}' % i) for i in range(5)], "session_id string, seq long, raw string").withColumn("message", F.try_parse_json("raw"))
    entries = summary.entry_documents(rows)
    asked = spark.createDataFrame([("s", "goal", "fix step"), ("t", "goal", "fix")], "session_id string, label string, query string")
    assert "raw#" in plan(entries) and "raw#" not in plan(many.scored(entries, many.asked_terms(asked)))
    assert {(r.session_id, r.n_hits) for r in many.hit_counts(entries, asked).collect()} == {("s", 5), ("t", 0)}


def test_role_alone(spark):
    found = [
        '{"role":"user","content":"x"}', '{"role":"assistant","content":[{"type":"thinking","thinking":"t"}]}', '{"role":"assistant","content":[{"type":"thinking","thinking":"t"},{"type":"toolCall","name":""}]}',
        '{"role":"toolResult"}', '{"content":[{"type":"thinking","text":"t"}]}', '{"role":"custom","content":""}', '{"role":7,"content":[{"type":"text","text":""},{"type":"thinking","thinking":"t"}]}', "{}", "[]", '{"role":"bashExecution"}', "broken",
    ]
    m = spark.createDataFrame([(x,) for x in found], "raw string").select(F.try_parse_json("raw").alias("m"))
    rows = m.select(M.rendered_role(F.col("m")).alias("role"), M.rendered(F.col("m"))["role"].alias("want")).collect()
    assert [r.role for r in rows] == [r.want for r in rows]
