"""The rows of each stage of the pipeline against plain versions, each on what its predecessor kept."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from logloom.llm import language, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    vocabulary = {"en": "the of and thing water house tree stone river light".split(), "de": "der und schöne straße wasser haus baum licht fluß stein".split(), "fr": "le été où forêt pierre lumière maison rivière être ça".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(vocabulary))
        lines = [" ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", str(i)]) for _ in range(rng.randrange(4, 30))) + "." for _ in range(rng.randrange(1, 7))]
        rows.append((i, "\n".join(lines), lang if i % 3 else None, rng.choice(["a", "b", None, "c"])))
    shared = "a line that many documents of this corpus hold"
    rows += [(100 + i, f"{shared}\n{rows[i][1]} {'extra ' * (i % 3)}end\n  {shared.upper()} ", "en", "b") for i in range(25)]
    rows += [(200 + i, rows[0][1], "en", "a") for i in range(4)] + [(300, None, "en", "a"), (301, "", None, "c"), (302, "12 34 !!", "en", "d"), (303, shared, "en", "a"), (304, "one long word " * 400, "en", "d"), (305, "x " * 9000, None, "e")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_language(rows, model):
    told = model.predict([r[1] for r in rows])
    return [r for r, (lang, _, ambiguous) in zip(rows, told, strict=True) if lang != "und" and not ambiguous]


def plain_lines(rows):
    key = lambda x: lower(x.strip(BLANKS))
    first = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            first[key(line)].add(i)
    out = []
    for i, t, lang, s, n in rows:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or min(first[key(x)]) == i]
        if len(kept) == len((t or "").split("\n")):
            out.append((i, t, lang, s, n))
        elif re.search(WORD, "\n".join(kept)):
            out.append((i, "\n".join(kept), lang, s, len("\n".join(kept))))
    return out


def plain_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(WORD, lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        least[top(k)] = min(least.get(top(k), r[0]), r[0])
    return [r for k, r in enumerate(rows) if not sets[k] or least[top(k)] == r[0]]


def plain_mix(rows):
    size = lambda t: len(re.findall(WORD, t or ""))
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * total[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest())
        budget = int(target[s] + 1e-6)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for r in own:
            n = size(r[1])
            cut = max(0, min(n, rest))
            rest -= cut
            out += [r] * (epochs if n else 0)
            if cut:
                text = r[1] if cut == n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])[:cut])
                out.append((*r[:1], text, *r[2:4], r[4] if cut == n else len(text)))
    return out


def test_stages(spark, corpus):
    docs = corpus.repartition(3)
    rows = [tuple(r) for r in corpus.collect()]
    model = language.fit(docs)
    plain = {"language_id": lambda x: plain_language(x, model), "line_dedup": plain_lines, "near_dedup": plain_near, "mixing": plain_mix}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == corpus.columns
        got, want = Counter(tuple(r) for r in made.collect()), Counter(plain[name](rows))
        assert got == want, (name, list((got - want).items())[:2], list((want - got).items())[:2])
        assert 0 < len(want) and (name == "mixing" or sum(want.values()) < len(rows))
        rows = list(want.elements())
        docs = spark.createDataFrame(rows, DOCS).repartition(3)
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    ids = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(i for i, x in ids for _ in x) == Counter({i: n for i, n in _lengths(pieces).items()})
    whole = Counter((i, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for i, x in ids)
    assert all(whole[p.doc_id, p.doc_tokens, p.ids_crc32] for p in pieces if p.length == p.doc_tokens)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[-1][0] + x[-1][1] <= 4096


@pytest.mark.parametrize("rows", [1, 7])
def test_more_parts_and_buckets_change_no_row(spark, corpus, monkeypatch, rows):
    """Parts of line dedup and buckets of mixing follow the number of documents: here many of a few rows each."""
    from logloom.llm import line_dedup, mixing

    def made():
        lines = sorted(map(repr, line_dedup.dedup_lines(corpus).collect()))
        return lines, sorted(map(repr, mixing.plan_mix(corpus.where("doc_id < 200")).collect()))

    want = made()
    monkeypatch.setattr(line_dedup, "PARTS", 1)
    monkeypatch.setattr(line_dedup, "PART_ROWS", rows)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    assert made() == want


def _lengths(pieces):
    out = Counter()
    for p in pieces:
        out[p.doc_id] += p.length
    return out
