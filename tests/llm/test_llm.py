import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import chat_format, embedding_dedup, entry, language, license_scan, line_dedup, mixing, near_dedup, packing, quality, url_filters

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rep string, doc string, kept string, line string"


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_rows_as_sql(name, same):
    same(entry.QUERIES[name], entry.ORACLES[name])


def words(n, seed):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 5003}x{seed}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names clash."""
    long = words(30_000, 1)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "\n\n", "en", None), (4, words(80, 2), "en", "a"), (4, words(80, 2), "en", "a"), (5, words(80, 2), None, "b"), (6, words(80, 2) + " Tail", "de", "b"), (None, words(80, 2), "de", None), (7, long, "de", "c"), (8, long + " end", "en", "c"), (9, "same line of text\nsame line of text\nother", "en", "a"), (10, "  SAME line of text \nshort", "en", "a"), (11, "٣ 42 !!", "en", "z")]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x", "y", "z", "k", "l") for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(odd, empty):
    got = quality.quality(odd).select("doc.doc_id", "n_words", "n_dup_lines", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[9].n_dup_lines == 1 and by[4].kept
    assert quality.quality(empty).count() == 0
    assert quality.repeat_words(b"a b c a b c d".split()) == 6 and quality.repeat_words(b"a a a a".split()) == 4
    nav = "Home | About | Contact | Help"
    assert quality.line_fails(nav, 7, 3) and not quality.line_fails("This is a plain sentence.", 5, 0)
    assert quality.line_fails("the same short line.", 4, 0, 2) and not quality.line_fails("the same short line.", 4, 0, 1) and quality.line_fails("Tous droits réservés.", 3, 0)
    assert quality.judge(nav + "\n" + ("A clean sentence stands here. " * 3).strip())[-1].startswith("A clean")


def test_line_dedup(odd, empty):
    done = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd)).select("doc.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    by = {r.doc_id: r for r in done}
    assert len(done) == odd.count() and by[9].n_dropped == 0 and by[10].kept_text == "short" and by[10].n_dropped == 1
    assert by[5].n_dropped == 1 and by[1].n_lines == 1 and by[3].n_lines == 3 and by[None].n_dropped == 0
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_one_id_with_two_texts(spark):
    a, b, c = ("the first shared line", "the second shared line", "a line of its own")
    rows = [(1, f"{a}\n{b}"), (2, f"{c} one\n{c} two\n{a}\n{b}"), (2, f"{a}\n{c} three"), (2, f"{b}"), (2, f"{a}\n{c} three"), (3, f"{c} three\n{a}\nshort")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    done = line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect()
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first[x] = min(i, first.get(x, i))
    want = [(i, len(t.split("\n")), "\n".join(x for x in t.split("\n") if len(x) < 10 or first[x] == i)) for i, t in rows]
    assert sorted((r.doc.doc_id, r.n_lines, r.kept_text) for r in done) == sorted(want)


def test_line_bitmaps(spark):
    """Documents of over 64 lines, a line that all hold, and lines far apart."""
    rows = [(i, "\n".join("a line that all documents hold" if k % 50 == 3 else f"line {k} of document {i if k % 7 else i % 3}" for k in range(40 * i))) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    got = {r.doc.doc_id: r for r in line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect()}
    for i, t in rows:
        left = [x for x in t.split("\n") if len(x) < 10 or first[x] == i]
        assert got[i].kept_text == "\n".join(left) and got[i].n_dropped == len(t.split("\n")) - len(left)


def brute_components(docs, width, percent):
    sets = {i: frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) for i, t in docs if (w := (t or "").encode().lower().split())}
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in docs}


def test_near_dedup(spark, odd, empty):
    got = {r.doc_id: r for r in near_dedup.near_classes(odd, 3, 85).collect()}
    assert got[5].component_id == 4 and got[6].component_id == 4 and not got[6].kept and got[8].component_id == 7
    assert got[1].component_id == 1 and got[1].n_shingles == 0 and got[2].kept and got[None].component_id is None and got[None].kept
    assert near_dedup.near_classes(empty).count() == 0
    docs = []
    for g in range(12):  # chains: each copy changes a little more
        base = words(120, g).split()
        for k in range(8):
            t = list(base)
            for j in range(k):
                t[10 * j] = f"new{g}_{j}"
            docs.append((100 * g + k, " ".join(t)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        mine = {r.doc_id: r.component_id for r in near_dedup.near_classes(frame, width, percent).collect()}
        assert mine == brute_components(docs, width, percent)
    kept = near_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (5, 6, 8)").count() == 0 and kept.where("doc_id is null").count() == 1


def test_near_dedup_of_one_id_with_two_texts(spark):
    a, b = words(60, 21), words(60, 22)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, b + " more"), (3, words(60, 23)), (4, words(60, 24)), (4, words(60, 24)), (5, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows + [(5, "")]], "doc_id long, text string, component string")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_classes(frame).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (3, 3), (4, 4), (4, 4), (5, 5), (5, 5)]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.dedup(frame).collect())
    assert kept == sorted([(1, a), (1, b), (3, words(60, 23)), (4, words(60, 24)), (5, ""), (5, "")])


def test_near_dedup_of_hot_groups(spark, monkeypatch):
    """The same components where every class, bucket and component counts as hot, and blocks hold a few sets."""
    docs = [(100 * g + k, " ".join([*words(80, g).split()[: 80 - k // 2], *(f"e{g}x{k}x{i}" for i in range(k // 2))])) for g in range(4) for k in range(30)]
    docs += [(1000 + k, words(80, 0)) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 3, 85)
    for name, value in (("BLOCK_ALL", 4), ("BLOCK_MINOR", 2), ("BLOCK_SHINGLES", 300)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "hot_from", lambda n: 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_classes(frame, 3, 85).collect()} == want


@pytest.mark.parametrize(("common", "percent"), [(8, 80), (17, 85)])
def test_near_pairs_at_the_limit(spark, common, percent):
    """Lone pairs exactly at the limit: none may leave as two documents."""
    docs, own = [], (100 * common // percent - common) // 2
    for g in range(6000):
        shared = [f"s{g}x{i}" for i in range(common)]
        docs += [(2 * g + k, " ".join(shared + [f"o{g}x{k}x{i}" for i in range(own + (k and (100 * common // percent - common) % 2))])) for k in (0, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert near_dedup.near_classes(frame, 1, percent).where("kept").count() == 6000


def test_embeddings(spark):
    import numpy as np

    r = np.random.default_rng(0)
    base = r.normal(size=(30, 64))
    many = [(k * 40 + j, (base[k] + r.normal(size=64) * s).tolist(), k % 3) for k in range(30) for j, s in enumerate([0, 0.05, 0.1, 0.14, 0.17])]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, many[0][1], None), (9004, many[0][1], many[0][2]), (9005, [1.0], 1), (None, many[0][1], 1), (9006, [None] + [1.0] * 63, 1)]
    frame = spark.createDataFrame([(i, v, c, "x") for i, v, c in many + odd], "vec_id long, embedding array<float>, label int, rep string")
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(frame).collect()}
    usable = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in many + [odd[4]]]
    links = {i: 0 for i, _, _ in usable}
    for i, v, c in usable:
        for j, w, e in usable:
            links[i] += i != j and c == e and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98
    found, total = sum(got[i].n_links for i in links), sum(links.values())
    assert total > 100 and found >= 0.99 * total and all(got[i].n_links <= n for i, n in links.items())
    assert got[9004].component_id == 0 and all(got[i].n_links == 0 and got[i].component_id == i for i in (9000, 9001, 9002, 9003, 9005, 9006))
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_repeated_ids(spark, monkeypatch):
    a, b, c, d = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [1.0, 0.01, 0, 0], [0, 1.0, 0.01, 0]
    rows = [(5, a, 1), (5, b, 1), (7, c, 1), (5, a, 2), (9, c, 2), (9, d, 3), (5, a, 1), (3, a, None)]
    frame = spark.createDataFrame([(i, [float(x) for x in v], k, 0) for i, v, k in rows], "vec_id long, embedding array<double>, label int, cid int")
    want = sorted([(5, 2, 5), (5, 2, 5), (5, 0, 5), (7, 2, 5), (5, 1, 5), (9, 1, 5), (9, 0, 9), (3, 0, 3)])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()) == want
    monkeypatch.setattr(embedding_dedup, "hot_from", lambda n: 1)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()) == want


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id <> 4").selectExpr("doc_id + 100000 as doc_id", "text"))
    extra = ["Don't STOP!! it's", "a…, b.", "<|endoftext|> X. <|ENDOFTEXT|>", "H̱x, Été%%% '' 'S", "日本語。 ok... 12.5% x's.", "\xa0, \x1c a\x1cb"]
    texts = texts.unionByName(spark.createDataFrame([(200000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    pieces = packing.pack(texts, packing.tokenizer_path()).collect()
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in texts.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        assert sum(p.length for p in own) == len(ids[d]) and len({p.start for p in own}) == len(own)
    pad = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    assert pad <= 0.01 * sum(map(len, ids.values())) + 4096 * 8
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def plain_windows(at, cost, size):
    """Least cost of windows that end at the last place, by trying every earlier cut."""
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if (n := at[j] - at[i]) <= size:
                best[j] = min(best[j], best[i] + cost[j] + packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 else size - n))
    return best[-1]


def test_packing_is_optimal():
    import random

    chance = random.Random(4)
    for size in (16, 64, 100):
        for _ in range(60):
            at = [0]
            while len(at) < chance.randint(2, 60):
                at.append(at[-1] + chance.randint(1, size // chance.choice((1, 2, 8))))
            cost = [chance.choice((0, 2, 8)) for _ in at]
            ends = packing.best_windows(at, cost, size, True)
            spent, begun = 0, 0
            for e in ends:
                n = e - begun
                assert 0 < n <= size
                spent += cost[at.index(e)] + packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 else size - n)
                begun = e
            assert begun == at[-1] and spent == plain_windows(at, cost, size)
    import numpy as np

    sizes = np.array([5, 0, packing.BATCH_BYTES * 2, 3, *[1] * 3000])
    parts = list(packing.batches_of(sizes))
    assert sum(n for _, n in parts) == len(sizes) and all(n <= packing.BATCH for _, n in parts) and (2, 1) in parts and not list(packing.batches_of(sizes[:0]))


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.with_language(docs, language.fit(docs)).where(language.held_out(F.col("doc.doc_id")))
    right = told.select(F.avg((F.col("doc.lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    got = {r.doc_id: r for r in language.with_language(odd, language.fit(docs)).select("doc.doc_id", "lang_pred", "score", "ambiguous").collect()}
    assert got[1].lang_pred == "und" and got[3].score == 0 and got[11].lang_pred == "und" and got[4].lang_pred != "und"
    assert language.with_language(odd, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.with_language(odd, language.fit(odd)).count() == odd.count() and language.keep_identified(odd).columns == odd.columns


def test_language_codes_and_weights():
    import numpy as np

    for n in (2, 3, 4, 5, 6, 9, 20, 60):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and all(abs(c.sum()) < n for c in code.T)
        assert language.least_distance(code) >= (1 if n == 2 else 2 if n == 3 else code.shape[1] / 4)
    # The closed form of rows left out equals fits without them.
    r = np.random.default_rng(1)
    y = np.repeat(np.arange(3), 8)
    x = (r.normal(size=(24, 30)) + np.eye(3)[y] @ r.normal(size=(3, 30))).astype(np.float32)
    model = language.Model(["a", "b", "c"], x, y)
    right = np.zeros(model.code.shape[1])
    for i in range(24):
        rest = np.arange(24) != i
        k = (x[rest] @ x[rest].T).astype(float) + np.eye(23) * language.RIDGE * 24 / 100
        f = x[i] @ (x[rest].T @ np.linalg.solve(k, model.code[y[rest]]))
        right += f * model.code[y[i]] > 0
    assert np.allclose(model.trust, np.maximum(0.05, np.log((right + 0.5) / (24 - right + 0.5))))


def test_language_of_many_and_ambiguous(spark):
    import random

    chance, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    tongue = [["".join(chance.choice(letters) for _ in range(chance.randint(3, 8))) for _ in range(40)] for _ in range(7)]
    say = lambda k, n: " ".join(chance.choice(tongue[k]) for _ in range(n))
    rows = [(i, say(i % 7, 40), f"l{i % 7}") for i in range(420)]
    docs = spark.createDataFrame([*rows, (1, rows[0][1], "l0"), (2, None, "l1"), (None, rows[3][1], None)], "doc_id long, text string, lang string")
    model = language.fit(docs, 20)
    assert model.langs == [f"l{k}" for k in range(7)] and model.code.shape == (7, 36)
    told = {r.doc.doc_id: r for r in language.with_language(docs.where("doc_id > 2"), model).collect()}
    assert sum(told[i].lang_pred == x and not told[i].ambiguous for i, _, x in rows if i > 2) >= 0.95 * len(told)
    halves = [" ".join(w for pair in zip(tongue[0], tongue[1]) for w in pair)]
    (lang, score, ambiguous), (_, sure, plain) = model.predict([*halves, say(2, 60)])
    assert lang in ("l0", "l1") and score < sure and not plain
    # Plain decoding: the codeword with the least weighted hinge loss.
    f = language.counts(halves[0]) @ model.weights
    loss = [sum(t * max(0, 1 - a * b) for t, a, b in zip(model.trust, f, c)) / model.trust.sum() for c in model.code]
    assert model.langs[loss.index(min(loss))] == lang and ambiguous == (sorted(loss)[1] - min(loss) < language.CLOSE)
    assert [r.lang_pred for r in language.with_language(docs.limit(1), language.fit(docs.where("lang = 'l3'"))).collect()] == ["l3"]


def test_mixing(spark, odd, empty):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count() and all(0 <= r.taken <= 3 * r["size"] for r in plan)
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and own[0].target <= 3 * own[0].source_size
    mixed = mixing.mix(odd)
    count = F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    assert mixed.columns == odd.columns and mixed.select(count).first()[0] == sum(r.taken for r in plan)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert sorted(map(repr, plan)) == sorted(map(repr, mixing.plan_mix(odd.repartition(3)).collect()))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://net", "http://x.net/", "https://example.com/de/", "https://notexample.com/de/", "x://y.org/fr/#a", "http://a.b/c://d.net/", "http://" + "a." * 500 + "net/" + "p" * 5000]
    frame = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "r")], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(frame, url_filters.rules_frame(spark, url_filters.RULES)).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.net/en/", "allow"), 4: (None, "allow"), 5: ("net/", "block"), 6: ("example.com/de/", "block"), 7: (None, "allow"), 8: ("org/fr/", "allow"), 9: (None, "allow"), 10: ("net/", "block")}


def test_many_url_rules(spark, monkeypatch):
    """Hot rules, rules given twice with other verdicts, and no rows."""
    rules = [*url_filters.RULES, ("a.b", "/x", "allow"), ("a.b", "/x", "block")]
    frame = spark.createDataFrame([(i, f"http://h{i % 3}.net/{i % 5}") for i in range(60)] + [(60, "http://c.a.b/xy"), (61, None)], "page_id long, url string")
    few = sorted(map(repr, url_filters.filter_urls(frame, url_filters.rules_frame(spark, rules)).collect()))
    monkeypatch.setattr(url_filters, "LISTED", 1)
    monkeypatch.setattr(url_filters, "hot_from", lambda n: 3)
    got = url_filters.filter_urls(frame, url_filters.rules_frame(spark, rules))
    assert sorted(map(repr, got.collect())) == few and {r.page_id: r.verdict for r in got.collect()}[60] == "block"
    assert url_filters.filter_urls(frame.limit(0), url_filters.rules_frame(spark, rules)).count() == 0


def test_licenses(spark, odd, empty):
    templates = spark.createDataFrame(license_scan.TEMPLATES, "name string, text string")
    grant = dict(license_scan.TEMPLATES)["MIT-grant"]
    noisy = grant.replace("granted", "given")
    frame = spark.createDataFrame([(i, t, "n") for i, t in enumerate([words(50, 3) + " " + grant.upper() + " tail", noisy, "Released under the MIT License", None, "MIT License", grant[:60]])], "doc_id long, text string, name string")
    got = sorted((r.doc_id, r.template) for r in license_scan.scan(frame, templates).collect())
    assert got == [(0, "MIT-grant"), (1, "MIT-grant"), (2, "MIT")]
    short = spark.createDataFrame([("two", "MIT License"), ("none", " . "), ("null", None), ("one", "Redistribution"), ("six", "under the MIT License and others")], "name string, text string")
    found = sorted((r.doc_id, r.template, r.n_shingles) for r in license_scan.scan(frame, short).collect())
    assert found == [(2, "two", 1), (4, "two", 1)]
    assert license_scan.scan(odd, templates).count() == 0 and license_scan.scan(empty, templates).count() == 0 and license_scan.scan(frame, templates.limit(0)).count() == 0


def test_many_license_templates(spark, monkeypatch):
    """The path for templates beyond the list gives the same rows."""
    templates = spark.createDataFrame(license_scan.TEMPLATES, "name string, text string")
    texts = dict(license_scan.TEMPLATES)
    frame = spark.createDataFrame([(i % 5, f"{words(20, i)} {t} {words(9, i)}") for i, t in enumerate(texts.values())] + [(None, texts["MIT"])], "doc_id long, text string")
    found = sorted(map(repr, license_scan.scan(frame, templates).collect()))
    assert len({r.template for r in license_scan.scan(frame, templates).collect()}) == len(texts)
    monkeypatch.setattr(license_scan, "LISTED", 3)
    assert sorted(map(repr, license_scan.scan(frame, templates).collect())) == found


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "x"), (6, None, None, "z"), (6, 0, "user", "z")]
    frame = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = chat_format.render(frame).orderBy("conv_id", "position").collect()
    assert sorted({r.conv_id for r in got}) == [2, 4, 5, 6]
    assert "".join(r.rendered for r in got if r.conv_id == 2) == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert [r.start for r in got if r.conv_id == 2] == [0, 19, 43] and chat_format.render(frame.limit(0)).count() == 0
    long = spark.createDataFrame([(c, t, "user", f"text {t % 7}") for c, n in ((1, 300), (2, 500), (3, 500)) for t in range(n)], "conv_id long, turn long, role string, text string").repartition(3)
    assert {(r.conv_id, r.n_turns, r["count"]) for r in chat_format.render(long).groupBy("conv_id", "n_turns").count().collect()} == {(2, 500, 500)}


def test_pipeline(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns
