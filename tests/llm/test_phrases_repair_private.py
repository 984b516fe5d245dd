"""Collocations, conversation repair and personal data against brute force on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import collocations, conversation_repair, personal_data

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, f long, word string, phrase string, bucket long, kind string, role string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, 2, "w", "p", 3, "k", "r") for i, t, lang in rows], DOCS).repartition(3)


# --- collocations ---


def plain_collocations(rows, least=10, longest=3, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        if not any(x == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in candidates.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    got, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return got


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "é", "a\x00b", "x", "y", "Ünder", "z"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", "", "", ",", "\n", "\t"]) for _ in range(rng.randrange(120))), rng.choice(["en", "en", None, "und", "de"])) for i in range(150)]
    return [*rows, (None, None, "en"), (7, "", None), (8, "New York city\tis big, New York", "en"), (8, "New York city\tis big, New York", "en"), (9, "aa " * 3000, "fr"), (10, "!!!...", "fr")]


@pytest.mark.parametrize("bucket,hot", [(collocations.BUCKET, None), (50, 100)])
def test_collocations(spark, phrase_rows, bucket, hot):
    """In the second case every word that occurs often is hot and dealt by two words, and buckets combine as they fill."""
    got = collocations.mine(docs_of(spark, phrase_rows), bucket=bucket, hot_rows=hot).collect()
    want = plain_collocations(phrase_rows)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_collocations_of_longer_phrases_and_few_rows(spark, phrase_rows):
    got = collocations.mine(docs_of(spark, phrase_rows), least=6, longest=4, top=7).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(phrase_rows, 6, 4, 7))
    assert collocations.mine(docs_of(spark, [])).count() == 0 == collocations.mine(docs_of(spark, [(1, None, None)])).count()


def test_growth_is_depth_first():
    import numpy as np

    rows, weights, _ = collocations.combined(collocations.project(np.array([1, 2, 3, 1, 2, 3, 0, 1, 2, 4, 0], np.int64), 3), np.ones(7, np.int64))
    assert list(collocations.grow(rows, weights, 2)) == [((1, 2), 3), ((1, 2, 3), 2), ((2, 3), 2)]


# --- conversation repair ---


def plain_repair(rows):
    """All ways to edit a short conversation; rows (turn, role, text) after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    for kinds in itertools.product("KRD", repeat=len(rows)):
        cost, out = 0, []
        for (_, role, text), k, fault in zip(rows, kinds, faults, strict=True):
            if fault in ("blank", "duplicate") and k != "D":
                break
            cost += {"K": 0, "R": 3, "D": 4}[k] + (3 if fault == "truncated" and k != "D" else 0)
            out.append((k, role, text))
        else:
            best = min(best, *inserted(out, cost)) if best else min(inserted(out, cost))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def inserted(edits, cost):
    """(cost, audit, lines) with every way to insert up to two turns in each place."""
    found = []
    for many in itertools.product(range(3), repeat=len(edits) + 1):
        state, audit, lines, ok, total = "", "", [], True, cost
        for k in range(len(edits) + 1):
            for _ in range(many[k]):
                role = "assistant" if state == "u" else "user"
                state, audit, total = role[0], audit + "I", total + 3
                lines.append(f"{role}:")
            if k == len(edits):
                break
            e, role, text = edits[k]
            audit += e
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == "u" else "user"
            if not ((role[:1] == "s" and state == "") or (role[:1] == "u" and state in ("", "s", "a")) or (role[:1] == "a" and state == "u")):
                ok = False
                break
            state = role[:1]
            lines.append(f"{role}:{text}")
        if ok and state in ("", "a"):
            found.append((total, audit, lines))
    return found or [(10**9, "", [])]


TURNS = "conv_id long, turn long, role string, text string, position long, fault string, place long, dropped boolean"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 8, False) for r in rows], TURNS).repartition(3)


def test_repair_of_short_conversations(spark):
    rng = random.Random(5)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", ""], ["Hi.", "Go on", "Yes!", "  ", "", "Hi.", "No?\n"]
    convs = {i: [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 5))] for i in range(60)}
    convs[None] = [(0, "user", "Null id."), (1, "assistant", "Yes.")]
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repairs(turns_of(spark, [(i, *r) for i, rs in convs.items() for r in rs])).collect()}
    assert len(got) == len(convs)
    for i, rs in convs.items():
        assert got[i] == plain_repair(sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))), (i, rs)


def test_long_conversations_and_small_batches(spark):
    """Segments and batches carry audits and hashes: a conversation of thousands of turns gives what one segment gives."""
    rng = random.Random(6)
    rows = [(i, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Well.", "Ah", f"No {k}."])) for i, n in ((1, 900), (2, 3), (3, 513), (4, 256), (5, 1)) for k in range(n)]
    frame = turns_of(spark, rows)
    want = {r.conv_id: r for r in conversation_repair.repairs(frame).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.conv_id: r for r in conversation_repair.repairs(frame).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
    fixes = spark.createDataFrame(list(want.values()), conversation_repair.repairs(frame).schema)
    turns = conversation_repair.repaired_turns(frame, fixes).collect()
    for i, r in want.items():
        own = sorted((t for t in turns if t.conv_id == i), key=lambda t: t.place)
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own)) and sum(c in "KRD" for c in r.audit) == sum(x[0] == i for x in rows)


def test_damage_and_empty_tables(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"Text {i} {t}. Why? No!") for i in range(30) for t in range(4)] + [(99, None, None, None), (100, 1, "user", "x" * 100_000)]
    kind = lambda i, t: zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in conversation_repair.damaged(turns_of(spark, rows)).where("not dropped").collect())
    want = Counter()
    for i, t, role, text in rows:
        k, role, text = kind(i, t), role or " ", text or " "
        if k:
            want[i, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text] += 1 + (k == 3)
    assert got == want and {kind(i, t) for i, t, *_ in rows} >= {0, 1, 2, 3, 4}
    lost = [(i, t) for i, t, *_ in rows if all(kind(i, x) == 0 for j, x, *_ in rows if j == i)] or [(next((i, t) for i in range(1000) for t in [0] if kind(i, t) == 0))]
    one = conversation_repair.repairs(conversation_repair.damaged(turns_of(spark, [(*lost[0], "user", "Hi.")]))).collect()
    assert [tuple(r) for r in one] == [(lost[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.repairs(turns_of(spark, [])).count() == 0


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def card(seed):
    rng = random.Random(seed)
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if passes("card", d + c))


@pytest.fixture(scope="module")
def private_rows():
    rng = random.Random(9)
    rows = [(i, f"Text é {i} {card(i)} and mail me.{i}@mail{i % 7}.example.com, call +1 (555) 555-{1000 + i} from 10.0.{i}.7 now.", "en") for i in range(40)]
    rows += [(100 + i, f"Order number {card(i)[:-1]}{(int(card(i)[-1]) + 1) % 10} was sent.", "en") for i in range(40)]
    odd = ["".join(rng.choice("0123456789.@+- ()ab%\n\x01é") for _ in range(rng.randrange(200))) for _ in range(150)]
    rows += [(200 + i, t, None) for i, t in enumerate(odd)]
    return rows + [(400, None, None), (401, "", "en"), (None, "a@b.c", "en"), (402, "1.2.3.4.5.6.7.8 0.0.0.256 001.2.3.4", None), (403, "a@b.c@d.e.f%x@y.z", None), (404, "7" * 60_000 + " x@y.zz " + "1 " * 60_000, None), (404, f"{card(1)} {card(2)}", "en"), (405, f"{card(1)} {card(2)}", "en"), (405, f"{card(1)} {card(2)}", "en"), (406, "+1 (826) 555-4081 190.137.223.204 du", "fr"), (407, "\U0001f600 10.0.0.1 \U0001f600", None)]


def test_base_spans_and_added_ones(spark, private_rows, tmp_path):
    docs_of(spark, private_rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = personal_data.op13_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(private_rows)
    left = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    for i, t, _ in private_rows:
        base = plain_base(t)
        n = Counter(x.split(":")[0] for x in base)
        left[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(base).encode()).hexdigest()] -= 1
    assert not any(left.values())
    by = {r.doc_id: r.spans for r in got}
    assert by[405] == "card:0:16,card:17:33" and "phone:0:17" in by[406] and "ip:18:33" in by[406]
    assert not any(by[100 + i] for i in range(40)) and all(set(plain_base(t)) <= set(by[i].split(",")) for i, t, _ in private_rows if i not in (404, 405) and t and i is not None and by[i])


def test_spans_of_a_kind_are_marked_out(spark):
    rows = [(1, "write to a.b@c.de or 10.1.2.3!", None), (2, "nothing here", None), (3, None, None), (4, "", None)]
    got = {r.doc_id: r.text for r in personal_data.masked(docs_of(spark, rows)).collect()}
    assert got == {1: "write to <email> or <ip>!", 2: "nothing here", 3: None, 4: ""}
    assert personal_data.spans(docs_of(spark, [])).count() == 0


def test_reliabilities_follow_the_votes():
    rows = [("card", 1, 1, 1, 1, 0, 1, 50), ("card", 0, -1, 1, 1, 0, 1, 45), ("card", 0, 1, 1, 1, 0, 1, 3), ("card", 0, 1, 0, -1, -1, -1, 4), ("card", 0, -1, 0, -1, -1, -1, 40)]
    p = personal_data.reliabilities(rows)
    assert p["card", 0, 1, 1, 1, 0, 1] > 0.8 > 0.2 > p["card", 0, 1, 0, -1, -1, -1] and p["card", 0, -1, 1, 1, 0, 1] < 0.05
    assert personal_data.reliabilities([]) == {}


def test_no_python_in_the_plan_of_spans(spark, private_rows):
    plan = personal_data.candidates(docs_of(spark, private_rows[:3]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ExistingRDD", "")) and F is not None


# --- language ID: what the fit sends to the driver ---


def test_fit_of_many_rows_without_id_or_with_equal_text(spark, monkeypatch):
    """Rows with a null or equal doc_id, and rows that repeat one text, never send more than their quota."""
    from logloom.llm import language

    frame = type(spark.range(1))
    sent, collect = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (rows := collect(self), sent.append(len(rows)))[0])
    ids, (a, b) = spark.range(6000), [i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    one = ids.selectExpr("cast(null AS long) AS doc_id", "concat('the text of row ', id) AS text", "'en' AS lang")
    two = ids.selectExpr(f"{a}L AS doc_id", "concat('der satz der zeile ', id) AS text", "'de' AS lang")
    same = ids.selectExpr(f"{b}L AS doc_id", "concat('la ligne ', id % 30, ' du texte') AS text", "'fr' AS lang")
    docs = one.unionByName(two).unionByName(same)
    model = language.fit(docs, per_language=50, most_rows=150)
    assert model.langs == ["de", "en", "fr"] and max(sent) <= 150 and sum(sent) <= 3 + 3 * 150
    assert [x[0] for x in model.predict(["the text of a row", "der satz", "la ligne du texte", "12"])] == ["en", "de", "fr", "und"]
    assert [len(language.fit(d, 50, 150).langs) for d in (docs.limit(0), same)] == [0, 1]


# --- license scans: what bands of windows retrieve ---


def plain_licenses(docs, templates, least=0.8):
    def words(t):
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:()\"'\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz" + " " * 13)
        return [w for w in t.translate(table).split(" ") if w]

    def shingles(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = []
    for doc_id, text in docs:
        for name, t in templates:
            w = words(t)
            want = shingles(w, min(5, len(w))) if w else set()
            n = len(want & shingles(words(text or ""), min(5, len(w))))
            if want and n / len(want) >= least:
                out.append((doc_id, name, len(want), n))
    return out


@pytest.mark.parametrize("listed", [20_000, 3])
def test_every_copy_of_a_license_is_found(spark, monkeypatch, listed):
    """Templates of 1 to 130 words, copied with edits that keep about 80 % of their shingles, in texts of other words."""
    from logloom.llm import license_scan

    monkeypatch.setattr(license_scan, "LISTED", listed)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    templates = [(f"t{n}", " ".join(word() for _ in range(n))) for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 22, 23, 24, 25, 30, 40, 60, 90, 130]]
    docs = []
    for k in range(160):
        text = [word() for _ in range(rng.randrange(30))]
        for _, t in rng.sample(templates, 3):
            w = t.split(" ")
            for _ in range(rng.randrange(len(w) // 20 + 2)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            text += [*w, word()]
        docs.append((k % 100, " ".join(text)))  # some ids hold two texts
    docs += [(None, templates[9][1]), (7, templates[5][1]), (7, "x " + templates[5][1]), (8, None), (8, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.template, r.n_shingles, r.n_found) for r in license_scan.scan(frame, spark.createDataFrame(templates, "name string, text string")).collect())
    want = sorted((repr(i), *rest) for i, *rest in plain_licenses(docs, templates))
    assert got == want and len(want) > 200
