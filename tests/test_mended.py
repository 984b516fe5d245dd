"""Readings of a query, facts and file hits on rows as the parser makes them."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import brief as W
from logloom.functions import relevance as R
from logloom.operators import drill, facts, search
from logloom.sources import messages as M


def entries(spark, docs):
    return spark.createDataFrame([(0, i, "user", t, t) for i, t in enumerate(docs)], "conv_id long, idx long, role string, text string, doc string")


def logged(spark, *found):
    rows = [("s", i, json.dumps(m)) for i, m in enumerate(found)]
    return M.as_blocks(spark.createDataFrame(rows, "session_id string, seq long, raw string").select("session_id", "seq", F.try_parse_json("raw").alias("message")))


@pytest.mark.parametrize(("patterns", "literals", "want"), [(60, 5, (45, 5)), (3, 40, (3, 40)), (60, 40, (25, 25)), (10, 0, (10, 0)), (0, 7, (0, 7)), (30, 60, (25, 25)), (10, 60, (10, 40))])
def test_both_readings_keep_their_share(spark, patterns, literals, want):
    docs = ["a 7z"] * patterns + [r"a \dz"] * literals + ["nothing"] * 3
    rows = search.both_readings(entries(spark, docs), r"a \dz").collect()
    count = lambda k: sum(r.reading == k for r in rows)
    assert (count("pattern"), count("literal")) == want
    ranked = search.ranks(entries(spark, docs), r"a \dz").collect()
    assert len(ranked) == sum(want) and all(r.total_before_cap == patterns + literals and r.truncated == (patterns + literals > 50) for r in ranked)
    assert [r.rn for r in ranked] == list(range(1, len(ranked) + 1))


def test_a_path_among_words_is_found(spark):
    docs = ["please fix the build"] * 3 + [r"see D:\nights\tally.txt for more"] + ["other"]
    found = {r.idx for r in search.ranks(entries(spark, docs), r"D:\nights\tally.txt").collect()}
    assert found == {3} and R.escaped(r"C:\a.b (x)") == r"C:\\a\.b \(x\)" and R.escaped("a-b c") == "a-b c"


def test_commits_of_parsed_shell_blocks(spark):
    run = lambda command, output: {"role": "bashExecution", "command": command, "output": output, "exitCode": 0}
    call = lambda name, command: {"role": "assistant", "content": [{"type": "toolCall", "name": name, "arguments": {"command": command}}]}
    result = lambda name, text: {"role": "toolResult", "toolName": name, "content": text}
    b = logged(
        spark, run('git commit -m "say \\"hi\\" twice"', "[main 1234567] say"), run("git commit -m plain", "wrote 12345678 bytes"), run("cd x && git -c a=b commit -am 'two'\ngit commit --message=three", "aaaaaaa..bbbbbbb main"),
        call("Bash", "git commit -m four"), result("read", "deadbeef"), result("bash", "deadbee four"), call("bash", "git commit -m five"), result("bash", "done"), result("bash", "ok cafe123"), call("grep", "git commit -m no"),
    )
    got = sorted((r.message, r.hash) for r in facts.commits(b).collect())
    assert got == [("five", "cafe123"), ("four", "deadbee"), ("plain", None), ('say "hi" twice', "1234567"), ("three", "bbbbbbb"), ("two", "bbbbbbb")]


def test_a_block_gives_the_next_new_preference(spark):
    said = ["Always use tabs here", "always use TABS here\nnever push to main", "Never push to main\nplease use bun\nplease avoid npm", "Do you prefer tabs?", "always use tabs here"]
    b = logged(spark, *[{"role": "user", "content": t} for t in said], {"role": "assistant", "content": "I prefer spaces"})
    assert [(r.nth, r.line) for r in facts.preferences(b).orderBy("nth").collect()] == [(1, "Always use tabs here"), (2, "never push to main"), (3, "please use bun")]
    many = logged(spark, *[{"role": "user", "content": f"please use tool {i}"} for i in range(14)])
    assert [r.line for r in facts.preferences(many).orderBy("nth").collect()] == [f"please use tool {i}" for i in range(10)]


def test_each_skill_is_named_once(spark):
    text = '- <skill name="a">\nlong body\n</skill>\nFix the login now\n<skill name="a">\nmore\n- </skill>\n<skill name="b" path="/x">\nThe end is open'
    df = spark.createDataFrame([(text,)], "t string").select(W.collapsed_skill_lines(F.split("t", "\n")).alias("l"), facts.goal_lines(F.col("t")).alias("g"))
    assert df.first()[:] == (["[skill: a]", "Fix the login now", "[skill: b]"], ["[skill: a]", "Fix the login now", "[skill: b]"])


def test_file_hits_in_any_case_and_capped(spark):
    call = lambda path, content: {"role": "assistant", "content": [{"type": "toolCall", "name": "write", "arguments": {"path": path, "content": content}}]}
    ops = M.file_operations(logged(spark, *[call(f"/r/f{i}.ts", "Login here\nlogin there") for i in range(55)], call("/r/É.ts", "(a+)+")))
    hits = drill.file_hits(ops, "LOGIN").collect()
    assert len(hits) == 55 and {r.n_lines for r in hits} == {2} and "Login here" in hits[0].snippet
    assert sorted(r.source for r in drill.file_hits(ops, "LOGIN", 50).collect()) == list(range(50)) == sorted(r.source for r in drill.file_hits(ops, None, 50).collect())
    assert [r.path for r in drill.file_hits(ops, "é.TS").collect()] == ["/r/É.ts"] and [r.source for r in drill.file_hits(ops, "(a+)+").collect()] == [55]


def test_arguments_as_written(spark):
    """Order and length are the log's, whatever else the content holds."""
    args = [{"z": "last", "a": "first", "n": 3, "list": ["x", {"q": "1", "b": "2", "c": 3}, ["deep"], None], "o": {"k": "v"}, "é": 'ü\n"q"'}, {}, {"b": []}]
    found = [{"role": "assistant", "content": [None, 5, {"type": "toolCall", "name": "grep", "arguments": a}, {"type": "text", "text": "said"}]} for a in args]
    raws = [json.dumps(m, ensure_ascii=False, indent=k) for k, m in enumerate(found)] + ['{"role":"user","content":"x"}', "{broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "seq long, raw string").withColumn("message", F.try_parse_json("raw"))
    m, raw = F.col("message"), F.col("raw")
    rows = df.select(M.content_chars(m, raw).alias("c"), M.message_tokens(m, raw).alias("t"), M.rendered(m, raw=raw)["summary"].alias("s"), M.search_document(m, raw=raw).alias("d")).collect()
    for r, a in zip(rows, args, strict=False):
        text = json.dumps(a, ensure_ascii=False, separators=(",", ":"))
        assert r.c == len("grep") + len(text) + 4 and r.t == -(-(4 + len(text)) // 4) + 1
        assert r.s == f"grep({', '.join(a)})\nsaid"
    assert rows[0].d == 'said\nlast\nfirst\nx\n1\n2\nü\n"q"' and rows[1].d == rows[2].d == "said" and (rows[3].c, rows[3].t, rows[3].d) == (1, 1, "x")


def test_responses(spark):
    from logloom.operators import responses

    asked = spark.createDataFrame([(1, "Head", 1000), (2, None, 0), (3, "Only", 50), (4, "H" * 90, 60)], "request_id long, header string, most long")
    parts = spark.createDataFrame([(1, 0, None, "a" * 100), (1, 1, "#7", "b" * 900), (1, 2, None, "c" * 900), (2, 0, None, "d" * 9000), (2, 1, None, None), (4, 0, "page 2", "e" * 10)], "request_id long, at int, label string, text string")
    got = {r.request_id: r.response for r in responses.capped(asked, parts).collect()}
    share = (1000 - 4 - 600) // 3
    assert got[1] == "\n\n".join(["Head", "a" * 100, "b" * share, "c" * share, "--- recall response capped at 1000 characters; omitted entrys: #7, entry 3 ---"])
    assert got[2] == "d" * 9000 and got[3] == "Only" and got[4] == "H" * 90 + "\n\n--- recall response capped at 60 characters; omitted entry: page 2 ---"
    pages = spark.createDataFrame([(1, "q", 1, "lineage", "hybrid", 2), (2, "q", 9, "all", "file", 3), (3, "none", 1, "lineage", "hybrid", 0)], "request_id long, query string, page long, scope string, mode string, total long")
    hits = spark.createDataFrame([(1, k, f"h{k}", False) for k in (1, 2)] + [(2, k, f"h{k}", False) for k in (1, 2, 3)], "request_id long, rn long, shown string, clipped boolean")
    got = {r.request_id: r.response for r in responses.pages(pages, hits, 2).collect()}
    assert got[1] == '2 matches for "q":\n\nh1\n\nh2' and got[3] == 'No matches for "none" in session history.'
    assert got[2] == "Page 9 is outside the available range 1-2 (3 matches (scope: all)). Use a page between 1 and 2 with mode:'file', or refine your query."
    paths = spark.createDataFrame([(p,) for p in ("/w/src/a.ts", "/x/y/z/b.ts", "c.ts", "C:\\a\\b\\c\\d.ts", "/wide/a")], "p string").select(responses.display_path(F.col("p"), "/w")).collect()
    assert [r[0] for r in paths] == ["./src/a.ts", ".../y/z/b.ts", "c.ts", ".../b/c/d.ts", "/wide/a"]


def test_whole_texts_are_wrapped(spark, tmp_path):
    """Every document has a row, blank and null ones too, and every line of it is wrapped, the longest as well."""
    import duckdb

    from logloom.operators import merging
    from logloom.plans import catalog, texts

    words = " ".join(["word"] * 40)
    found = [(1, None), (2, ""), (3, f"  \n{words}\n\n\tlast  \x0b line "), (4, f"short\n{'z' * 300}"), (4, "a\\ " * 60), (5, "some words " * 20000)]
    spark.createDataFrame(found, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r[:] for r in texts.wrapped_lines(spark, str(tmp_path)).select("doc_id", "lines", "back", "fits").collect()]
    assert got[:2] == [(1, None, None, None), (2, "- ", "- ", True)]
    assert got[2][1].split("\n") == ["- ", "- " + " ".join(["word"] * 23), "  " + " ".join(["word"] * 17), "- ", "- last line"] and got[2][2] == f"- \n- {words}\n- \n- last line"
    assert got[3][1].split("\n") == ["- short", "- " + "z" * 117 + "\\", "  " + "z" * 117 + "\\", "  " + "z" * 66] and got[3][2] == "- short\n- " + "z" * 300
    assert got[5][2] == "- " + " ".join(["some words"] * 20000) and got[5][1].count("\n") > 1800 and all(r[3] for r in got[1:])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, got)) == sorted(map(repr, c.execute(catalog.ORACLES["wrapped_lines"]).fetchall()))
    odd = spark.createDataFrame([("\n  x",), ("a\\\n  \\\n\tb  \nc ",), ("c \n  d \n- e\n   \n f",)], "t string").select(merging.joined_lines(F.col("t")).alias("j")).collect()
    assert [r.j for r in odd] == [[" x"], ["ab", "c "], ["c  d", "- e", "    f"]]
