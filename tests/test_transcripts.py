import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.functions import brief as T
from logloom.functions import text as X
from logloom.operators import brief, drill, summary, windows
from logloom.plans import transcripts
from logloom.sources import messages as M

DATA = "/root/testdata/sf0.001"


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def got(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def logged(spark, *found):
    rows = [("s", i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(found)]
    return spark.createDataFrame(rows, "session_id string, seq long, raw string").select("session_id", "seq", F.try_parse_json("raw").alias("message"))


def call(name, **arguments):
    return {"role": "assistant", "content": [{"type": "toolCall", "name": name, "arguments": arguments}]}


def test_word_limits(spark):
    df = texts(spark, "the quick brown fox", "alpha beta the gamma delta", "", None, "don't stop  3.14\r\nnow")
    assert got(df, T.first_words(F.col("t"), 3)) == ["the quick brown fox", "alpha beta the gamma...(truncated)", "", None, "don't stop 3.14...(truncated)"]
    words = texts(spark, " ".join(f"w{i}" for i in range(10)), "w1 the w2 w3")
    assert got(words, T.ends_of_words(F.col("t"), 2, 1)) == ["w0 w1\n...(middle truncated)...\nw9", "w1 the w2 w3"]
    assert got(texts(spark, "Hmm, well, so it works", "wait"), T.without_self_talk(F.col("t"))) == ["so it works", "wait"]
    skill = 'a <skill name="lint" x>body</skill> b <skill name="open"> tail'
    assert got(texts(spark, skill), T.collapsed_skills(F.col("t"))) == ["a [skill: lint] b [skill: open]"]
    assert got(texts(spark, skill), T.collapsed_skill_tags(F.col("t"))) == ["a [skill: lint] b [skill: open] tail"]


@pytest.mark.parametrize(
    ("raw", "short"),
    [
        ("set -e\ncd /x && npm test | sort | tail -5\n", "npm test"), ("python3 - <<PY\nimport os\nprint(1)\nPY\nls", "python3 - <<PY print(1); ls"), ("cat > f <<'EOF'\nbody\nEOF\ngit push", "cat > f <<'EOF'; git push"),
        ("set -e", "set -e"), ("echo $((8 << 20))\nmake", "echo $((8 << 20)); make"), ("x <<EOF\nnever closed", "x <<EOF; never closed"), ("", ""), ("a" * 300, "a" * 237 + "..."),
    ],
)
def test_commands(spark, raw, short):
    assert got(texts(spark, raw, None), T.short_commands(F.col("t"))) == [short, None]


def test_wrapping(spark):
    line = "- " + " ".join(["word"] * 40)
    pieces, hard, same, none = (None if x is None else x.split("\n") for x in got(texts(spark, line, "x" * 300, "a short line\n\nb", None), T.wrapped(F.col("t"))))
    assert all(len(x) <= 120 for x in pieces) and all(x.startswith("  ") for x in pieces[1:]) and same == ["a short line", "", "b"] and none is None
    assert all(len(x) <= 120 for x in hard) and "".join(x.removesuffix("\\") for x in hard) == "x" * 300
    assert got(texts(spark, "\n".join(pieces)), T.rejoined(F.col("t"))) == [line]


def test_bytes_paths_and_terms(spark):
    whole = "aé€😀" * 3
    for most in range(1, 31):
        want = whole.encode()[:most].decode(errors="ignore")
        assert got(texts(spark, whole), X.clip_bytes(F.col("t"), most)) == [want]
    assert got(texts(spark, "a,b.ts\nc"), X.escape_commas(F.col("t"))) == ["a\\,b.ts c"]
    assert got(texts(spark, "a\\,b, c,"), X.split_escaped(F.col("t"))) == [["a,b", "c"]]
    assert got(texts(spark, "Fix the parser", ""), X.holds_terms(F.col("t"), F.lit("PARSER fix"))) == [True, False]


def test_odd_messages_never_fail(spark):
    rows = logged(
        spark, "null", "[]", {"role": "user"}, {"role": "user", "content": [None, 5, {"type": "text", "text": 7}]}, {"role": "assistant", "content": 3}, {"role": "assistant", "content": [{"type": "toolCall", "name": 4}]},
        {"role": "robot", "content": "x"}, {"role": "user", "content": "a\r\nb\x1b[31mc"}, "{broken", {"role": "bashExecution", "command": 3}, {"role": "custom", "content": ""},
    )
    b = [(r.source, r.kind, r.text, r.name) for r in M.as_blocks(rows).orderBy("blk").collect()]
    assert b == [(2, "user", "", None), (3, "user", "", None), (5, "tool_call", None, None), (7, "user", "a\nbc", None), (9, "bash", None, None)]
    assert M.usage(rows).first().n == 11 and brief.lines(M.as_blocks(rows)).count() == 3


def test_brief_lines(spark):
    rows = logged(
        spark, {"role": "user", "content": "fix it"}, call("read", path="/a"), {"role": "toolResult", "toolName": "read", "content": "x"}, call("read", path="/a"), call("read", path="xd://b"),
        *[call("grep", query=f"q{i}") for i in range(9)], {"role": "assistant", "content": "Hmm, done\nall"}, {"role": "bashExecution", "command": "set -e\nmake", "output": "", "exitCode": 0},
    )
    lines = [r.line for r in brief.lines(M.as_blocks(rows)).orderBy("n").collect()]
    calls = [f'* grep "q{i}" (#{i + 5})' for i in range(1, 9)]
    assert lines == ["[user]", "fix it (#0)", "", "[assistant]", "* (3 earlier tool-call entries omitted)", *calls, "done", "all (#14)", "", "[user]", "$ make (#15)"]
    same = logged(spark, call("read", path="/a"), {"role": "toolResult", "toolName": "read", "content": "x"}, call("read", path="/a"))
    assert [r.line for r in brief.lines(M.as_blocks(same)).orderBy("n").collect()] == ["[assistant]", '* read "/a" (#0, result #1, #2) x2']


def test_capped_and_merged(spark):
    rows = spark.createDataFrame([("s", n, "[user]" if n % 10 == 1 else f"l{n}", 300) for n in range(1, 301)], "session_id string, n long, line string, total long")
    r = brief.capped(rows).first()
    assert r.brief.startswith("...(180 earlier lines omitted)\n\n[user]\nl182") and r.brief_lines == 120
    old, new = "\n".join(f"o{i}" for i in range(100)), "\n".join(f"n{i}" for i in range(50))
    merged = got(texts(spark, old), brief.merged_brief(F.col("t"), F.lit(new)))[0].split("\n")
    assert len(merged) <= 120 and merged[0] == "...(33 earlier lines omitted)" and merged[-50:] == new.split("\n")
    assert got(texts(spark, "", None), brief.merged_brief(F.col("t"), F.lit(new))) == [new, new]


def greedy(rows, floor, ceiling, slope, most, recent, n):
    budget, used, keys, taken = min(ceiling, max(floor, slope * n)), 0, set(), []
    rows = sorted(rows, key=lambda r: -r.blk)
    for r in [r for r in rows if r.blk >= n - min(recent, most) and r.kind != "tool_result"]:
        if used + r.cost <= budget:
            used, taken = used + r.cost, [*taken, r.blk]
            keys |= {r.key} - {None}
    for r in sorted(rows, key=lambda r: (-r.score, -r.blk)):
        if len(taken) < most and r.kind != "tool_result" and r.blk not in taken and (r.key is None or r.key not in keys) and used + r.cost <= budget:
            used, taken = used + r.cost, [*taken, r.blk]
            keys |= {r.key} - {None}
    return sorted(taken)


@pytest.mark.parametrize("limits", [(4400, 8000, 60, 80, 16), (300, 900, 10, 12, 3), (100, 100, 1, 4, 8)])
def test_selection_is_the_greedy_one(spark, limits):
    b = transcripts.parsed(spark, DATA).cache()
    cost = F.char_length("header") + F.char_length("body") + F.char_length(F.col("source").cast("string")) + 6
    costs = {(r.session_id, r.blk): r.c for r in brief.rendered(b, F.lit(True)).select("session_id", "blk", cost.alias("c")).collect()}
    per, n = defaultdict(list), {}
    for r in brief.B.ranked(b).withColumn("key", brief.same_fact()).withColumn("cost", F.lit(1)).collect():
        row = type("R", (), {"blk": r.blk, "score": r.score, "kind": r.kind, "key": r.key, "cost": costs.get((r.session_id, r.blk), 1)})
        per[r.session_id].append(row)
    n = {s: len(rows) for s, rows in per.items()}
    want = {(s, k) for s, rows in per.items() for k in greedy(rows, *limits, n[s])}
    assert {(r.session_id, r.blk) for r in brief.selected(b, *limits).collect()} == want and want
    b.unpersist()


def test_summary_and_back(spark):
    rows = logged(
        spark, {"role": "user", "content": "Please fix the login page\nalways use tabs here"}, call("edit", path="/r/a/x,1.ts", oldText="a", newText="b"), call("write", path="/r/a/y.ts", content="c"),
        call("bash", command='git commit -m "fix login"'), {"role": "toolResult", "toolName": "bash", "content": "[main abc1234] fix login"}, {"role": "assistant", "content": "The build still fails on the server"},
    )
    out = summary.summaries(M.as_blocks(rows)).cache()
    text = out.first().summary
    assert text.startswith("[Session Goal]\n- Please fix the login page\n- always use tabs here\n\n[Files And Changes]\n- Modified (in /r/a/): x\\,1.ts, y.ts\n\n[Commits]\n- abc1234: fix login\n\n[Outstanding Context]\n- The build still fails")
    assert "\n\n---\n\n[user]\n" in text and text.endswith(summary.NOTE) and "User Preferences" not in text
    assert out.select(summary.section_of(F.col("summary"), "Commits")).first()[0] == "- abc1234: fix login"
    assert not out.select(summary.without_note(F.col("summary"))).first()[0].endswith("---")
    r = summary.reports(rows, M.as_blocks(rows)).first()
    assert (r.messages, r.calls, r.n_sections, r.file_mentioned, r.problem_mentioned) == (6, 3, 4, True, True)


def test_many_files(spark):
    files = spark.createDataFrame([("s", "Read", f"/r/d{i // 30}/f{i}", i) for i in range(130)], "session_id string, category string, path string, first_blk long")
    lines = [r.line for r in summary.category_lines(files).orderBy("nth").collect()]
    assert lines[0].startswith("Read: /r/d0/f0, ") or lines[0].startswith("Read (in /r/): d0/f0, ")
    assert [x[: x.index(")") + 1] for x in lines[1:]] == ["Read (+10 more under /r/d0/)", "Read (+30 more under /r/d1/)", "Read (+30 more under /r/d2/)", "Read (+10 more under /r/d3/)", "Read (+30 more)"]


def test_outputs_after_the_last_assistant_are_pending(spark):
    out = lambda n: {"role": "toolResult", "content": [{"type": "text", "text": "x" * 4 * n}]}
    rows = logged(
        spark, out(90), out(10), out(60), out(60), out(60), out(30), {"role": "bashExecution", "output": "y" * 400, "excludeFromContext": True}, {"role": "assistant", "content": "done", "stopReason": "stop"},
        out(500), {"role": "assistant", "content": "", "stopReason": "aborted"}, {"role": "bashExecution", "output": "z" * 2000},
    )
    found = M.outputs(rows.withColumn("id", F.expr("CASE seq WHEN 3 THEN NULL WHEN 4 THEN 'twice' WHEN 9 THEN 'twice' ELSE concat('m', seq) END")))
    shown = windows.output_projection(found, 60).orderBy("seq").collect()
    assert [(r.seq, r.kept) for r in shown] == [(0, False), (1, True), (2, False), (3, True), (4, True), (5, True), (8, True), (10, True)]
    assert [r.seq for r in shown if r.pending] == [8, 10] and {r.n_pending for r in shown} == {2}
    assert all(r.kept for r in windows.output_projection(found, 0).collect())
    assert all(r.kept and r.pending for r in windows.output_projection(found.where("not done"), 60).collect())


def test_only_whole_scaffolding_is_penalised(spark):
    def reasons(kind, name, command, exit_code=0, path=None, files=None):
        b = spark.createDataFrame([("s", 0, kind, name, command, exit_code, path, "")], "session_id string, blk long, kind string, name string, command string, exit_code int, path string, text string")
        return set(brief.B.scores(b, files).first().reasons)

    for command, trivial in (
        ("set -e\nmake deploy", False), ("export A=1\nnpm run deploy", False), ("cd /x\npwd", True), ("  \n# a\n\techo hi", True), ("cat > f <<EOF\nls\nEOF", False),
        ("echo <<EOF\nmake\nEOF\nls", True), ("echo << EOF\nmake", False), ("echo <<EOF\nmake\n", False), ("ls\r\n", True), ("", True),
    ):
        assert ("trivial-bash" in reasons("bash", None, command)) == trivial, command
        assert ("trivial-bash" in reasons("tool_call", "Bash", command)) == (trivial and command != ""), command
    assert "trivial-bash" not in reasons("bash", None, "ls", 2)
    assert reasons("tool_call", "monitor", "npm test && git push") == {"tool-call"} and reasons("tool_call", "monitor", "ls") == {"tool-call"}
    assert reasons("tool_call", "bash", "npm test && git push") == {"test-command", "workflow-command"}
    files = spark.createDataFrame([("s", "/r/a.py", "modified"), ("s", "/r/a.py", "read"), ("s", "b.txt", "read"), ("t", "/r/c.py", "read")], "session_id string, path string, activity string")
    assert reasons("tool_call", "edit", None, path="/r/a.py", files=files) == {"edit-tool", "hook-modified-file", "hook-read-file"}
    assert reasons("bash", None, "make b.txt", files=files) == {"bash", "hook-read-file"} and reasons("tool_call", "edit", None, path="/r/c.py", files=files) == {"edit-tool"}


def test_drill_down(spark):
    body = "\n".join(f"l{i}" for i in range(50))
    two = {"role": "assistant", "content": [{"type": "toolCall", "name": "edit", "arguments": {"path": p, "edits": [{"oldText": "a"}, {"newText": "b"}]}} for p in ("/r/x.ts", "/r/y.ts")]}
    ops = M.file_operations(M.as_blocks(logged(spark, call("write", path="/r/big.ts", content=body), two, call("read", path="/r/z.ts"), call("write", path="xd://p", content="c"), call("edit", path="/r/q", edits=[5]))))
    asks = [(1, "s", 0, "big", False, 45, 0), (2, "s", 1, ".ts", False, None, None), (3, "s", 1, "y.ts", True, None, None), (4, "s", 2, "file", False, None, None), (5, "s", 0, "file", False, 99, None)]
    out = {r.request_id: r for r in drill.expand_files(ops, spark.createDataFrame(asks, "request_id int, session_id string, source long, pattern string, full boolean, offset int, limit int")).collect()}
    assert out[1].shown == "l45\nl46\nl47\nl48\nl49" and out[1].total_lines == 50
    assert (out[2].n_matches, out[2].paths, out[2].shown) == (2, "/r/x.ts,/r/y.ts", None)
    assert out[3].shown == "--- edit 1 ---\na\n--- becomes ---\n\n\n--- edit 2 ---\n\n--- becomes ---\nb"
    assert (out[4].n_matches, out[5].shown) == (0, None) and ops.count() == 3
    assert drill.file_hits(ops).count() == 3 and [r.n_lines for r in drill.file_hits(ops, "l4").collect()] == [11]


def test_lines_of_split_files(spark, tmp_path):
    from logloom.sources.sessions import read_lines

    raws = [f'{{"id": "{i}", "pad": "{"x" * (i % 90)}"}}' if i % 11 else "" if i % 2 else "{broken" for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(raws) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(raws[:50]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
        got = rows.selectExpr("split_part(session_id, '/', -1) f", "line", "try_variant_get(entry, '$.id', 'string') id", "entry is null bad").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(f, i, str(i) if i % 11 else None, i % 11 == 0) for f, n in (("a.jsonl", 400), ("b.jsonl", 50)) for i in range(n) if raws[i]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
