import json

from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import facts, recall, summary, windows
from logloom.sources import messages as M


def one(spark, value, make):
    df = spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "raw string").select(F.try_parse_json("raw").alias("m"))
    return df.select(make(F.col("m")).alias("x")).first()[0]


MIXED = {"role": "assistant", "content": [{"type": "thinking", "thinking": "deep", "text": "other"}, {"type": "text", "text": "said"}, None, {"type": "toolCall", "name": "grep", "arguments": {"pattern": "x", "list": ["a", {"k": "b", "n": 1}], "n": 2}}]}


def test_messages_as_text(spark):
    assert one(spark, MIXED, M.search_document) == "said\ndeep\na\nb\nx" and one(spark, MIXED, M.thoughts) == "deep"
    assert tuple(one(spark, MIXED, M.rendered)) == ("assistant", "grep(list, n, pattern)\nsaid")
    assert tuple(one(spark, MIXED, lambda m: M.rendered(m, True))) == ("assistant", "[thinking]\ndeep\n\ngrep(list, n, pattern)\nsaid\n\n[tool args]\na\nb\nx")
    assert tuple(one(spark, {"role": "assistant", "content": [{"type": "thinking", "text": "only"}]}, M.rendered)) == ("thinking", "only")
    python = {"role": "pythonExecution", "code": "1+1", "output": "2"}
    assert tuple(one(spark, python, M.rendered)) == ("python", ">>> 1+1\n2") and one(spark, python, M.search_document) == "1+1 2" and one(spark, python, M.message_text) == "1+1\n2"
    files = {"role": "fileMention", "files": [{"path": "a", "content": "b"}, None]}
    assert tuple(one(spark, files, M.rendered)) == ("file_mention", "a\nb\n\n")
    own = {"role": "toolResult", "toolName": "Recall", "content": "x"}
    assert one(spark, own, M.search_document) == "" and tuple(one(spark, own, M.rendered)) == ("tool_result", "[Recall] x")
    assert one(spark, {"role": "user", "content": "y" * 400}, M.rendered).summary == "y" * 300 and one(spark, {"role": "compactionSummary", "summary": "s"}, M.message_text) == "s"
    assert one(spark, MIXED, M.preview) == "[thinking]\nsaid\n[unknown]\n[toolCall:grep]" and one(spark, "{}", M.search_document) == ""
    assert one(spark, {"role": "user", "content": [{"type": "image"}, {"type": "text", "text": "abcde"}, {"type": "thinking", "text": "not counted"}]}, M.message_tokens) == 1202
    assert one(spark, {"content": [{"type": "thinking", "thinking": "abc", "text": "longer text"}]}, M.content_chars) == 3


def test_markers(spark):
    content = {"content": [{"type": "image"}, {"type": "text", "text": "a", "id": 1}, {"type": "text", "text": "b"}]}
    got = one(spark, content, lambda m: F.transform(M.with_marker(m, F.lit("#4")), lambda p: F.to_json(p)))
    assert [json.loads(x) for x in got] == [{"type": "image"}, {"type": "text", "text": "#4", "id": 1}]
    rows = spark.createDataFrame([(0, '{"role":"custom","customType":"host"}'), (1, '{"role":"custom"}'), (2, '{"role":"user","customType":"host"}')], "i int, raw string").select("i", F.try_parse_json("raw").alias("message"))
    assert sorted(r.i for r in M.without_markers(rows, ["host"]).collect()) == [1, 2]


def test_details(spark):
    def good():
        return {"compactor": "c", "version": 3, "summaryMode": "append", "chainStart": True, "trailingSummary": "t", "sections": ["a"], "sourceMessageCount": 0, "previousSummaryUsed": False,
                "segment": {"sequence": 1, "summary": "s", "tokensBefore": 10, "coverage": {"firstCoveredEntryId": "a", "lastCoveredEntryId": "b", "firstKeptEntryId": "", "sourceMessageCount": 1}}}

    check = lambda d: one(spark, d, lambda m: M.valid_details(m, "c"))
    assert check(good()) and check(good() | {"retainedToolOutputProjection": {"version": 1, "retainedTokens": 0, "omittedTokens": 1.5, "pendingCount": 0, "omissions": [{"entryId": "x", "marker": "#1"}]}})
    for key, value in (("version", 2), ("chainStart", "yes"), ("trailingSummary", ""), ("sections", ["a", ""]), ("sections", None), ("sourceMessageCount", -1), ("sourceMessageCount", 1.5), ("segment", None), ("retainedToolOutputProjection", {"version": 1})):
        assert not check(good() | {key: value})
    for key, value in (("sequence", 0), ("summary", ""), ("tokensBefore", -1), ("coverage", []), ("coverage", {"firstCoveredEntryId": "a"})):
        assert not check(good() | {"segment": good()["segment"] | {key: value}})
    assert not check("[]") and not check("null")


def test_small_functions(spark):
    df = spark.createDataFrame([(2.7,), (-3.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(T.positive_or(F.col("x"), 1, 1)).collect()] == [2, 1, 1, 1]
    assert df.select(T.joined_within(F.array(F.lit("ab"), F.lit("cd")), 4), T.tokens_of_chars(F.lit(10), F.lit(4.0))).first()[:] == ("ab\nc", 3)


def test_sinks(spark, tmp_path):
    rows = spark.range(2)
    for _ in range(2):
        recall.append_metrics(rows, str(tmp_path / "m"))
        recall.snapshot(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4 and spark.read.json(str(tmp_path / "s")).count() == 2


def test_index_of_two_sources(spark):
    schema = "session_id string, seq long, entry_id string, type string"
    loaded = spark.createDataFrame([("a", 0, "x", "message")], schema)
    scanned = spark.createDataFrame([("a", 0, "old", "message"), ("b", 0, "x", "message"), ("b", 1, "x", "message"), ("b", 2, "y", "message")], schema)
    index = windows.resolved_index(loaded, scanned)
    assert sorted(map(tuple, index.collect())) == [("a", "x", 0), ("b", "y", 2)]
    wanted = spark.createDataFrame([("b", "x"), ("b", "y")], "session_id string, entry_id string")
    assert sorted((r.entry_id, r.idx) for r in windows.with_global_index(wanted, index).collect()) == [("x", None), ("y", 2)]


def test_goals_and_preferences(spark):
    schema = "session_id string, blk long, kind string, text string"
    text = 'Fix the <skill name="lint">long</skill> parser\nRead the issue in full, with all comments\nFor each issue:\nDo this as well\n'
    b = spark.createDataFrame([("s", 0, "user", text), ("s", 1, "user", "please use tabs?... or so"), ("s", 2, "user", 'please use <skill name="x">' + "y" * 300 + "</skill>")], schema)
    assert facts.goals(b).first().goals[0] == "Fix the [skill: lint] parser" and "Do this as well" not in facts.goals(b).first().goals and len(facts.goals(b).first().goals) == 1
    assert [r.line for r in facts.preferences(b).collect()] == ["please use [skill: x]"]
    long = "The build still fails on the server. " + "And more words follow here. " * 6
    assert facts.blockers(spark.createDataFrame([("s", 0, "user", long)], schema)).first().line.endswith(".")


def test_created_files(spark):
    blocks = spark.createDataFrame([("s", 0, "tool_call", "edit", "/a"), ("s", 1, "tool_call", "read", "/b")], "session_id string, blk long, kind string, name string, path string")
    host = spark.createDataFrame([("s", "Created", "/a"), ("s", "Created", "/c"), ("s", "Read", "dev://x"), ("s", "Read", "/b")], "session_id string, category string, path string")
    assert sorted((r.category, r.path, r.first_blk) for r in summary.touched_files(blocks, host).collect()) == [("Created", "/c", -1), ("Modified", "/a", 0), ("Read", "/b", -1)]


def test_merged_briefs(spark):
    schema = "session_id string, goals array<string>, commits array<string>, blockers array<string>, preferences array<string>, brief string"
    old = spark.createDataFrame([("a", ["g"], [], ["b"], ["p"], "[user]\nold"), ("b", ["g"], None, [], [], "x")], schema)
    new = spark.createDataFrame([("a", ["h", "g"], ["c"], [], [], "[user]\nnew"), ("c", ["n"], [], [], [], "y")], schema)
    got = {r.session_id: r for r in summary.merged_sections(old, new).collect()}
    assert (got["a"].goals, got["a"].blockers, got["a"].brief) == (["g", "h"], ["b"], "[user]\nold\n\n[user]\nnew") and got["b"].brief == "x" and got["c"].goals == ["n"] and len(got) == 3


def test_results(spark):
    rows = spark.createDataFrame([(1, "user", "body"), (2, "bash", "x")], "i long, role string, body string")
    none = F.lit(None)
    shown = rows.select(F.struct("i").alias("place"), recall.hit_text(F.col("i"), F.col("role"), none.cast("array<string>"), none.cast("array<struct<path:string,tool:string,n_lines:int,snippet:string>>"), F.col("body")).alias("shown"), F.lit(False).alias("clipped"))
    assert recall.output(shown).first()[0] == "Session history (2 entries):\n\n#1 [user] body\n\n#2 [bash] x"
    assert recall.output(shown, "q", "Touched", True).first()[0].startswith('Touched for "q":\n') and recall.output(shown, "q", truncated=True).first()[0].endswith(recall.HINT)
    assert recall.output(shown.limit(0)).first()[0] == "No entries in session history." and recall.output(shown.limit(0), "q").first()[0] == 'No matches for "q" in session history.'
