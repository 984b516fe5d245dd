"""Phrase collocation mining by contiguous pattern growth (PrefixSpan with gap zero).

1. Words are counted per language; a word's 64-bit hash, of language and word, stands for it. Hashes are checked over all distinct words,
   and another seed is taken if two meet, so counts by hash are exact.
2. Each corpus block projects its occurrences: an occurrence of a frequent word points at the words that follow it in its
   piece, as far as the longest phrase. Words that are not frequent end a piece, as no frequent phrase holds one; a bitmap of
   FILTER_BITS bits tells them, whatever the vocabulary's size (words that share a bit with a frequent one only cost traffic).
   Equal projections of a block become one with a count.
3. Projections are dealt by prefix: each frequent word's lie in one task, sorted, where the phrase grows to the right depth
   first, every phrase projecting its own slice of pointers. A word with so many occurrences that it would fill a task (hot) is dealt
   by its first two words instead: its own count is known, and every longer phrase stays in one task.
4. Cuts and longer phrases are joins on the phrases' hashes; scores are exact decimals.

Defined cases: null text is empty; a null lang is `und`, and counts with rows of that lang; repeated rows count each time; an
empty table gives no rows; texts of any length are one stream of words, blocks are bounded in words except that one text
is never split; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, hot_from, table, written

#: Bytes: A-Z to lower case, a tab to a space, marks and line ends to 0xFF, which UTF-8 never holds.
_TO = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LEAST, LONGEST, TOP, COVERED = 10, 3, 2000, 50
#: Words in a block; projections in a task's bucket, about; bits of the filter; words in a task's memory.
BLOCK, BUCKET, FILTER_BITS, MEMORY = 1 << 21, 1 << 20, 1 << 26, 400_000


def tokens(text: str) -> list[bytes]:
    """Words in order, and 0xFF where a piece ends."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TO).replace(b"\xff", b" \xff ").split(b" ") if w]


class _Hashes(dict):
    """Word to signed 64-bit hash, never 0; 0xFF to 0."""

    def __init__(self, lang: str, seed: int):
        import xxhash

        self.head, self.seed, self.hash = lang.encode("utf-8", "surrogatepass") + b"\0", seed, xxhash.xxh64_intdigest
        self[b"\xff"] = 0

    def __missing__(self, word: bytes) -> int:
        h = self.hash(self.head + word, self.seed)
        h = (h - (1 << 64) if h >> 63 else h) or 1
        if len(self) < MEMORY:
            self[word] = h
        return h


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            yield ("und" if lang is None else lang), text


def counted_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, h, f of every distinct word."""

    def count(batches):
        found: dict[str, Counter] = {}

        def out():
            for lang, c in found.items():
                c.pop(b"\xff", None)
                if c:
                    h = _Hashes(lang, seed)
                    words = list(c)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(words), "word": pa.array(words, pa.binary()), "h": [h[w] for w in words], "f": list(c.values())})
            found.clear()

        for batch in batches:
            for lang, text in _texts(batch):
                found.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, found.values())) > MEMORY:
                    yield from out()
        yield from out()

    local = docs.select("lang", "text").mapInArrow(count, "lang string, word binary, h long, f long")
    return local.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes, of which those of frequent words are set; at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.expr(f"pmod(h, {FILTER_BITS}L)")
    rows = frequent.select(F.shiftright(bit, 6).alias("slot"), F.expr("shiftleft(1L, cast(pmod(h, 64L) as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h & (FILTER_BITS - 1)) >> 6] >> (h & 63)) & 1 == 1


def _mixed(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def combined(rows: np.ndarray, weights: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal columns of rows summed, in the order of `first`, then of the columns; and the order's places."""
    keys = [*rows[::-1]] if first is None else [*rows[::-1], first]
    order = np.lexsort(keys)
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return rows[:, starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0], order[starts]


def project(ids: np.ndarray, longest: int) -> np.ndarray:
    """A column for each occurrence that a word follows: it and the next words of its piece, 0 where the piece has ended."""
    padded = np.concatenate([ids, np.zeros(longest - 1, np.int64)])
    rows = np.stack([padded[k : k + len(ids)] for k in range(longest)])
    for k in range(1, longest):
        rows[k][rows[k - 1] == 0] = 0
    return rows[:, (rows[0] != 0) & (rows[1] != 0)]


def grow(rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of two words or more with their counts, depth first; rows in order, by column."""
    longest = len(rows)

    def right(prefix: tuple[int, ...], lo: int, hi: int) -> Iterator[tuple[tuple[int, ...], int]]:
        depth = len(prefix)
        own = rows[depth, lo:hi]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if hi - lo > 1 else np.zeros(1, np.int64)
        sums = np.add.reduceat(weights[lo:hi], starts)
        ends = np.append(starts[1:], hi - lo)
        for k in np.flatnonzero((sums >= least) & (own[starts] != 0)):
            phrase = (*prefix, int(own[starts[k]]))
            if depth:
                yield phrase, int(sums[k])
            if depth + 1 < longest:
                yield from right(phrase, lo + int(starts[k]), lo + int(ends[k]))

    if rows.shape[1]:
        yield from right((), 0, rows.shape[1])


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int = 0, least: int = LEAST, longest: int = LONGEST, bucket: int = BUCKET, hot_rows: int | None = None) -> DataFrame:
    """lang, phrase (array of word hashes), f of all phrases of 2 to `longest` words found at least `least` times."""
    spark = docs.sparkSession
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-total // bucket))
    # At most HOT_SHARE words, unless hot_rows says otherwise.
    hot = np.sort(words.where(F.col("f") >= (hot_rows or max(bucket // 8, hot_from(total)))).select("h").toArrow()["h"].to_numpy())
    shared = spark.sparkContext.broadcast((_bitmap(words.where(F.col("f") >= least)), hot))

    def projections(batches):
        bits, hot = shared.value
        maps: dict[str, _Hashes] = {}
        blocks: dict[str, list[np.ndarray]] = {}

        def out():
            for lang, parts in blocks.items():
                ids = np.concatenate(parts)
                ids[~_known(bits, ids)] = 0
                rows = project(ids, longest)
                if not rows.shape[1]:
                    continue
                by = _mixed(rows[0])
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, rows[0]), len(hot) - 1)
                    of_hot = hot[at] == rows[0]
                    by[of_hot] = _mixed(rows[0][of_hot], rows[1][of_hot])
                place = (by % np.uint64(buckets)).astype(np.int64)
                rows, weights, order = combined(rows, np.ones(rows.shape[1], np.int64), place)
                place = place[order]
                starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(starts[1:], len(place))
                for lo, hi in zip(starts, ends, strict=True):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": [int(place[lo])], "n": [int(hi - lo)], "block": [rows[:, lo:hi].tobytes() + weights[lo:hi].tobytes()]})
            blocks.clear()

        held = 0
        for batch in batches:
            for lang, text in _texts(batch):
                own = tokens(text)
                own.append(b"\xff")
                to = maps.setdefault(lang, _Hashes(lang, seed))
                blocks.setdefault(lang, []).append(np.fromiter(map(to.__getitem__, own), np.int64, len(own)))
                held += len(own)
                if held >= BLOCK:
                    yield from out()
                    held = 0
                    maps.clear()
        yield from out()

    def phrases(batches):
        key, parts, held = None, [], 0
        found: dict[str, list] = {"lang": [], "phrase": [], "f": []}

        def joined():
            rows, weights, _ = combined(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
            return rows, weights

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(found["lang"], pa.string()), pa.array(found["phrase"], pa.list_(pa.int64())), pa.array(found["f"], pa.int64())], ["lang", "phrase", "f"])
            for x in found.values():
                x.clear()
            return batch

        def done():
            for phrase, f in grow(*joined(), least):
                found["lang"].append(key[0])
                found["phrase"].append(phrase)
                found["f"].append(f)
                if len(found["f"]) >= 50_000:
                    yield out()

        for batch in batches:
            for lang, b, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and key != (lang, b):
                    yield from done()
                    parts, held = [], 0
                key = (lang, b)
                both = np.frombuffer(block, np.int64)
                parts.append((both[:-n].reshape(longest, n), both[-n:]))
                held += n
                if held > 2 * bucket:  # equal projections of earlier blocks become one
                    parts = [joined()]
                    held = min(bucket, parts[0][0].shape[1])
        if key is not None:
            yield from done()
        yield out()

    dealt = docs.select("lang", "text").mapInArrow(projections, "lang string, bucket long, n long, block binary")
    dealt = dealt.repartition(max(1, min(int(buckets), 100_000)), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(phrases, "lang string, phrase array<bigint>, f long")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: the lowest-scoring cut of every phrase."""
    known = phrases.unionByName(words.select("lang", F.array("h").alias("phrase"), "f"))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("slice(phrase, 1, k)").alias("head"), F.expr("slice(phrase, k + 1, size(phrase))").alias("rest"))
    # The hash holds the language, so phrases of two languages never meet.
    cuts = cuts.join(known.select(F.col("phrase").alias("head"), F.col("f").alias("l")), "head").join(known.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest")
    d = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {d('a')} * {d('a')}) div ({d('l')} * {d('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase").agg(least).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """candidates (phrase, a) without those of which a longer one holds at least `covered` percent of the occurrences."""
    n = F.size("phrase")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda s: F.slice("phrase", s, m))))
    inner = candidates.where(n > 2).select(F.explode(spans).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    joined = candidates.join(inner, "phrase", "left")
    return joined.where(~F.coalesce(100 * F.col("longer") >= covered * F.col("a"), F.lit(False))).drop("longer")


def ranked(candidates: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by score, count and text, with n, all of the language's words."""
    order = [F.col("score").desc(), F.col("a").desc()]
    # Those that can be among the first, ties and all: within each of 64 parts first, so a large language isn't one task's.
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64)))
    near = candidates.withColumn("at", F.rank().over(part.orderBy(*order))).where(F.col("at") <= top)
    near = near.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= top).drop("at")
    spelt = near.select("lang", "phrase", F.posexplode("phrase").alias("pos", "h")).join(words.select("h", F.col("word").cast("string").alias("word")), "h")
    spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("said"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    rows = near.join(spelt, ["lang", "phrase"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "said"))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("said").alias("phrase"), "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, bucket: int = BUCKET, hot_rows: int | None = None) -> DataFrame:
    """The collocations of docs (lang, text): lang, rank, phrase, a, l, r, n, score."""
    for seed in range(8):
        words = written(counted_words(docs, seed))
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
        forget(words)
    else:
        raise RuntimeError("word hashes met with every seed")
    frequent = words.where(F.col("f") >= least)
    phrases = written(frequent_phrases(docs, words, seed, least, longest, bucket, hot_rows))
    found = written(ranked(uncovered(scored(phrases, frequent), covered), words, top))
    forget(words, phrases)
    return found


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT lang, [w[i]] AS ph FROM i UNION ALL SELECT lang, w[i:i + 1] FROM i WHERE i + 1 <= len(w) UNION ALL SELECT lang, w[i:i + 2] FROM i WHERE i + 2 <= len(w)),
f AS (SELECT lang, ph, count(*) AS f FROM t GROUP BY lang, ph),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1 AND f >= 10),
k AS (SELECT c.*, u.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c, LATERAL (SELECT unnest(range(1, len(c.ph))) AS k) u JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:u.k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[u.k + 1:len(c.ph)]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
x AS (SELECT lang, ph[1:2] AS ph, a FROM c WHERE len(ph) = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE len(ph) = 3),
m AS (SELECT lang, ph, max(a) AS longer FROM x GROUP BY lang, ph),
g AS (SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.ph = b.ph WHERE NOT coalesce(100 * longer >= 50 * a, false))
SELECT g.lang, row_number() OVER (PARTITION BY g.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM g JOIN n ON n.lang = g.lang QUALIFY rank <= 2000
"""
