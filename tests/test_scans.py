"""Scans of files of any size, and searches that take too long."""

import time

import pytest

from logloom.operators import search
from logloom.sources import sessions


def test_outcomes_of_files(spark, tmp_path):
    long = [f'{{"id": "{i}", "pad": "{"x" * (i % 50)}"}}' if i % 9 else ["", "{broken", " "][i // 9 % 3] for i in range(900)]
    (tmp_path / "a b.jsonl").write_text("\n".join(long))
    (tmp_path / "b.jsonl").write_text("")
    (tmp_path / "c.jsonl").write_text("no json\r\n\r\n{}\r\n")
    paths = [str(tmp_path / n) for n in ("a b.jsonl", "b.jsonl", "none.jsonl", "c.jsonl", "none.jsonl")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        lines, told = sessions.scan(spark, paths)
        rows = lines.selectExpr("split_part(session_id, '/', -1) f", "line", "try_variant_get(entry, '$.id', 'string') id").collect()
        outcomes = {r.path: (r.missing, r.n_lines, r.n_errors) for r in told.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [(i, x) for i, x in enumerate(long) if x.strip()]
    assert outcomes == {paths[0]: (False, len(kept), sum(x == "{broken" for _, x in kept)), paths[1]: (False, 0, 0), paths[2]: (True, 0, 0), paths[3]: (False, 2, 1)}
    assert sorted((r.line, r.id) for r in rows if r.f.startswith("a")) == [(i, None if x == "{broken" else str(i)) for i, x in kept]
    lines, told = sessions.scan(spark, [paths[2]])
    assert lines.count() == 0 and told.first().missing
    with pytest.raises(Exception, match="(?i)path|directory|file"):
        sessions.scan(spark, ["nosuchscheme://x/y"])


def test_a_search_ends_within_its_budget(spark):
    slow = spark.createDataFrame([(0, i, "user", t, t) for i, t in enumerate(["a" * 34 + "!"] * 400 + ["plain"])], "conv_id long, idx long, role string, text string, doc string").repartition(4)
    began = time.time()
    with pytest.raises(search.SearchAborted, match="0.5 s"), search.budget(spark, 0.5):
        search.ranks(slow, "(a|aa)+$").collect()
    assert time.time() - began < 60
    with search.budget(spark, 120):
        assert [r.idx for r in search.ranks(slow, "plain").collect()] == [400]
    with pytest.raises(ValueError), search.budget(spark, 60):
        raise ValueError("its own error")
