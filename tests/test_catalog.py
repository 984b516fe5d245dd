import pytest

from logloom.functions import relevance as R
from logloom.plans import catalog, recall, texts, transcripts  # noqa: F401  all add their queries to the catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_patterns():
    assert R.nested_quantifier("(a+)+$") and R.nested_quantifier(r"(\w*)*") and not R.nested_quantifier("(ab)+c*")
    assert R.safe_pattern("(a+)+$") == r"\(a\+\)\+\$" and R.safe_pattern("[a") == r"\[a" and R.safe_pattern("a.b") == "a.b"
    assert R.looks_like_regex("a|b") and not R.looks_like_regex("auth.ts")
    assert R.query_terms("the auth and login") == ["auth", "and", "login"] and R.query_terms("the of") == ["the", "of"]


def graded(spark, docs):
    from pyspark.sql import functions as F

    rows = [(0, i, "user", t) for i, t in enumerate(docs)]
    return spark.createDataFrame(rows, "conv_id long, idx long, role string, text string").withColumn("doc", F.concat_ws(" ", "role", "text", F.lit("")))


def test_gate_keeps_covering_documents(spark):
    from logloom.operators import search

    docs = ["alpha beta gamma delta alpha beta", "alpha beta gamma delta", "alpha filler words here", "alpha other filler words", "delta filler words again more"]
    kept = search.search(graded(spark, docs), "alpha beta gamma delta").orderBy("rn").collect()
    assert [r.idx for r in kept] == [0, 1] and kept[0].probability > 0.5


def test_single_term_bypasses_gate(spark):
    from logloom.operators import search

    kept = search.search(graded(spark, ["auth " * 20, "auth", "nothing"]), "auth").collect()
    assert [r.idx for r in kept] == [0, 1]


def test_facts(spark):
    from logloom.operators import facts

    rows = [
        ("s", 0, "user", None, None, "Please use tabs for this\nok"), ("s", 1, "tool_call", "bash", 'git commit -m "fix login" && git commit -m two', ""), ("s", 2, "tool_result", "bash", None, "[main abc1234] fix login"),
        ("s", 3, "user", None, None, "The build still fails on the server"), ("s", 4, "tool_call", "TodoWrite", None, ""), ("s", 5, "user", None, None, "<system-reminder>x</system-reminder>"),
    ]
    b = spark.createDataFrame(rows, "session_id string, blk long, kind string, name string, command string, text string")
    assert [(r.message, r.hash) for r in facts.commits(b).collect()] == [("fix login", "abc1234"), ("two", "abc1234")]
    assert [r.line for r in facts.preferences(b).collect()] == ["Please use tabs for this"]
    assert [r.line for r in facts.blockers(b).collect()] == ["[user] The build still fails on the server"]
    assert sorted(r.blk for r in facts.without_noise(b).collect()) == [0, 1, 2, 3]


def test_json_lines(spark, tmp_path):
    from logloom.sources import sessions

    (tmp_path / "a.jsonl").write_text('{"id":"m1","type":"message","message":{"role":"user","content":"x"}}\r\n\n{broken\n{"id":"c","type":"compaction","firstKeptEntryId":""}\n')
    lines = sessions.read_lines(spark, str(tmp_path))
    e = sessions.parse_errors(lines).first()
    assert (e.n_lines, e.n_errors) == (3, 1)
    got = [(r.entry_id, r.type, r.role, r.first_kept) for r in sessions.typed_entries(lines).orderBy("seq").collect()]
    assert got == [("m1", "message", "user", None), ("c", "compaction", None, "")]


def test_stream_counts(spark, tmp_path):
    from logloom.streaming import sessions

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"session":"s","type":"message","message":{"role":"user"}}\n{"session":"s","type":"reset_boundary"}\n{"session":"s","type":"message","message":{"role":"assistant"}}\nbad\n')
    q = sessions.live_counts(sessions.stream_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("s", 2, 1, 1)]


def test_median_without_one_task(spark):
    import statistics

    from pyspark.sql import functions as F

    from logloom.operators import search

    for n in (1, 2, 7, 8, 2499, 2500, 9001, 30000):
        rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(n // 2 + 1)).cast("double").alias("score"))
        near = rows.agg(F.percentile_approx("score", [0.4998, 0.5002], search.ACCURACY)).first()[0]
        assert search.median(rows, "score", n, near) == statistics.median(r[0] for r in rows.collect())


def test_terms_of_patterns_and_scripts(spark):
    from logloom.operators import search

    assert R.query_terms("日本go 語") == ["日", "本go", "語"] and R.query_terms("a 日") == ["日"] and R.query_terms("日+ x") == ["日+"]
    docs = ["colour and color", "colour", "nothing", "日本 colour"]
    assert [r.idx for r in search.search(graded(spark, docs), "colou?r zz+").orderBy("rn").collect()][0] == 0
    assert [(r.idx, r.text) for r in search.search(graded(spark, docs), "日本").collect()] == [(3, docs[3])]
    assert search.search(graded(spark, []), "colour").count() == 0 and search.search(graded(spark, docs), "").count() == 0
