"""Items whose terms a document holds: odd rows against the query's SQL, and no shuffle of texts."""

import pytest

from logloom.operators import terms
from logloom.plans import catalog, texts  # noqa: F401  adds its queries to the catalog

ITEMS = [
    (0, "Alpha  beta\nGAMMA"), (1, "a"), (2, "b\x0bc d"), (3, "x y"), (4, ""), (5, None), (6, " \t"), (7, "日本 語"), (8, "alpha alpha"), (9, "zz nowhere"),
    (10, "one two"), (10, "three four"), (11, "one two"), (11, "one two three"), (12, "ab"), (12, "ab"), (13, "beta alpha gamma"),
]
DOCS = [
    (0, "gammabeta xalphax"), (1, "alpha\tbeta"), (2, "B\x0bC\r\ndd"), (3, "xx yy"), (4, None), (5, ""), (6, "これは日本の語"), (7, "one two"), (8, "four three"), (9, "one two three four"), (10, "a" * 3000 + "lphabetagamma"),
    (20, "one"), (20, "two"), (21, "one two"), (21, "one two"), (22, "alpha beta gamma"), (22, "nothing"), (23, "ab"), (24, "\x0balpha\x0bbeta gamma"),
]


@pytest.mark.parametrize("room", [terms.ROOM, 20])
def test_odd_rows_as_in_sql(spark, room):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", DOCS)
    want = sorted(c.execute(catalog.ORACLES["documents_with_terms"]).fetchall())
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(tuple(r) for r in terms.all_terms(docs, items, room).collect()) == want and len(want) > 10
    assert terms.all_terms(docs, items.where("item_id < 0")).count() == 0 and terms.all_terms(docs.where("doc_id < 0"), items).count() == 0


def test_runs_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(terms, "KNOWN", 2)
    asked = terms.Asked([(2, ["bcd", "a"], [1]), (1, ["z"], [2, 3])])
    assert sorted(i for low in ("abcd e f g", "z y x w", "a bc d", "abcd") for _, _, items in asked.whole(low) for i in items) == [1, 1, 2, 3]


def test_no_shuffle_of_texts(spark):
    plan = texts.documents_with_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" in plan and "Exchange" not in plan
