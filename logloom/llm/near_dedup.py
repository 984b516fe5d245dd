"""MinHash near-dedup of documents: exact components of the links that banding proposes.

Steps: (1) each text gives its set of word shingles as 64-bit hashes, and multiply-shift minima, ROWS for each
band, whose hash is the band's key; (2) rows with equal sets (two 64-bit hashes) form a class; (3) in each band bucket
every class is compared with the bucket's first one: signatures first, then full sets; (4) components of those links by
large-star and small-star; (5) in buckets that still hold several components, the classes outside the first one's
component are compared, on full sets, with all classes of other components, in blocks of bounded size; (6) components
again. So within each bucket every pair that could still join two components is confirmed or refuted, though a bucket's
pairs are never listed. A hot class, bucket or component meets its rows by a broadcast of bounded size (join_hot), and
sets meet in blocks of at most BLOCK_ALL by BLOCK_MINOR sets and about BLOCK_SHINGLES shingles.

Tables between the steps lie in the shared folder; all but the result's are deleted before the result is returned.

The limit gives the number of bands: so many that a pair at the limit meets in none with probability MISS (1e-6) at
most. At 0.85 that is 24 bands of 5 rows (7.7e-7), at 0.80 35 bands (9.2e-7). The signature test lets pass what is within
5 standard deviations of the limit.

Defined cases: null or blank texts have an empty set and link with nothing; so do rows with a null doc_id (kept, null
component); rows that repeat a doc_id are each looked at, each in its own text's component, which dedup() keeps one row of;
an empty table gives no rows; other columns are left out of the classes and carried by dedup().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, forget, hot_from, join_hot, table, written
from .graph import components

ROWS, MISS = 5, 1e-6
BLOCK_MINOR, BLOCK_ALL, BLOCK_SHINGLES = 256, 1024, 1 << 20
WORD_MEMORY = 300_000


def bands_for(percent: int) -> int:
    """The least number of bands in which a pair at the limit meets but for MISS."""
    meets = (percent / 100) ** ROWS
    return 1 if meets >= 1 else math.ceil(math.log(MISS) / math.log1p(-meets))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}
        odd = np.random.default_rng(3).integers(1, 2**62, width, np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = odd

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORD_MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        x = np.full(n, width, np.uint64)
        for i in range(width):
            x += h[i : i + n]
            x *= self.factors[i]
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.unique(x)


class Minima:
    """Signatures: n minima of a*x+b modulo 2**64, the upper half of each (multiply-shift)."""

    def __init__(self, n: int) -> None:
        r = np.random.default_rng(4)
        self.a = (r.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = r.integers(0, 2**63, n, np.uint64)[:, None]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(x), 1024):
            part = self.a * x[None, k : k + 1024]
            part += self.b
            np.minimum(best, part.min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, set hash f1 and f2, and signature of every row."""
    names = ["doc_id", "text_key", "n_shingles", "f1", "f2", "sig"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, minima = Shingler(width), Minima(hashes)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part, rows = batch.slice(k, 2000), []
                for doc_id, key, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    x = sets(text)
                    if not len(x):
                        rows.append((doc_id, key, 0, 0, 0, None))
                        continue
                    rows.append((doc_id, key, len(x), _set_hash(x), _set_sum(x), minima(x).view(np.int32)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, text_key long, n_shingles long, f1 long, f2 long, sig array<int>"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "xxhash64(text) as text_key", "cast(text as string) as text").mapInArrow(signed, schema)


def band_keys(sig: Column, bands: int) -> Column:
    """One 64-bit key for each ROWS minima of a signature."""
    return F.array(*[F.xxhash64(F.lit(k), *[sig[k * ROWS + i] for i in range(ROWS)]) for k in range(bands)])


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set (array<long>), n and set hash f1 and f2 of every row."""
    names, kinds = ["doc_id", "set", "n", "f1", "f2"], [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                own = [sets(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0).to_pylist(), [x.view(np.int64) for x in own], [len(x) for x in own], [_set_hash(x) for x in own], [_set_sum(x) for x in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(made, "doc_id long, set array<long>, n long, f1 long, f2 long")


def _set_hash(x: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(x ^ (x >> np.uint64(7))).view(np.int64)) if len(x) else 0


def _set_sum(x: np.ndarray) -> int:
    return int(x.sum().view(np.int64)) if len(x) else 0


def _similar(common, na, nb, percent: int):
    return 100 * common >= percent * (na + nb - common)


def block_links(percent: int):
    """For sorted rows of blocks: pairs of components that a pair of similar sets joins."""

    def common(q: list[np.ndarray], m: list[np.ndarray]) -> np.ndarray:
        vocabulary = np.unique(np.concatenate(q))
        if len(q) == 1:
            at = np.minimum(np.searchsorted(vocabulary, flat := np.concatenate(m)), len(vocabulary) - 1)
            ends = np.cumsum([len(s) for s in m])
            return np.diff(np.cumsum(vocabulary[at] == flat)[ends - 1], prepend=0)[None, :]
        total = np.zeros((len(q), len(m)), np.float32)

        def where(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.searchsorted(vocabulary, flat)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == flat
            return at[hit], row[hit]

        (qa, qr), (ma, mr) = where(q), where(m)
        for k in range(0, len(vocabulary), 4096):
            a, b = np.zeros((len(q), 4096), np.float32), np.zeros((len(m), 4096), np.float32)
            one, two = (qa >= k) & (qa < k + 4096), (ma >= k) & (ma < k + 4096)
            a[qr[one], qa[one] - k] = 1
            b[mr[two], ma[two] - k] = 1
            total += a @ b.T
        return total

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch | None:
            q, m = [r for r in rows if r[0]], [r for r in rows if not r[0]]
            if not q or not m:
                return None
            found: set[tuple[int, int]] = set()
            nm, cm = np.array([len(r[2]) for r in m]), np.array([r[1] for r in m])
            for k in range(0, len(m), BLOCK_ALL):
                c = common([r[2] for r in q], [r[2] for r in m[k : k + BLOCK_ALL]])
                nq, cq = np.array([len(r[2]) for r in q])[:, None], np.array([r[1] for r in q])[:, None]
                ok = _similar(c.astype(np.int64), nq, nm[None, k : k + BLOCK_ALL], percent) & (cq != cm[None, k : k + BLOCK_ALL])
                i, j = np.nonzero(ok)
                found.update(zip(cq[i, 0].tolist(), cm[k + j].tolist(), strict=True))
            if not found:
                return None
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for r, block in enumerate(zip(*(c.to_pylist() for c in columns[:3]), strict=True)):
                if block != key:
                    if (out := done()) is not None:
                        yield out
                    key, rows = block, []
                rows.append((columns[3][r].as_py(), columns[4][r].as_py(), columns[5][r].values.to_numpy(zero_copy_only=False)))
        if (out := done()) is not None:
            yield out

    return linked


def row_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and group of every row of docs; linked: 100 * common >= percent * united.

    group numbers the component (null for rows that link with nothing): rows that repeat a doc_id may have several.
    """
    bands = bands_for(percent)
    hashes = bands * ROWS
    signed = written(signatures(docs, width, hashes))
    # No step has more rows than there are band keys, so at most HOT_SHARE keys of any step are hot.
    hot = hot_from(signed.count() * bands)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    own_class = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n_shingles", "sig"), "doc_id").alias("v"))
    classes = written(own_class.select(F.monotonically_increasing_id().alias("cid"), "f1", "f2", "rep", "copies", "v.*"))
    keyed = classes.select("cid", F.col("n_shingles").alias("n"), F.explode(band_keys(F.col("sig"), bands)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"), F.count("*").alias("members"))
    first = written(first.where("lead < last").drop("last"))
    # The buckets of several classes: small beside all keys.
    shared = written(join_hot(keyed, first, ["key"], "members", hot).select("key", "cid", "n", "lead"))
    proposed = shared.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    # Signatures: what lies over 5 standard deviations below the limit cannot be similar enough.
    p = percent / 100
    least = int(hashes * max(0.0, p - 5 * (p * (1 - p) / hashes) ** 0.5))
    proposed = written(proposed)
    per_lead = written(proposed.groupBy("a").agg(F.count("*").alias("pairs")))
    sig = classes.select("cid", "n_shingles", "sig")
    leads = sig.toDF("a", "na", "sa").join(per_lead, "a")
    pairs = join_hot(proposed.join(sig.toDF("b", "nb", "sb"), "b"), leads, ["a"], "pairs", hot)
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely = written(pairs.where(fits & (equal >= least)).select("a", "b"))
    # Full sets of the classes in these buckets, read once; a merge join at every size, as the ids grow with the input.
    wanted = classes.join(shared.select("cid").distinct().hint("merge"), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "f1", "f2")
    asked = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = shingle_sets(asked, width).where("n > 0").join(wanted, ["doc_id", "f1", "f2"]).select("cid", "set", "n")
    sets = written(sets.dropDuplicates(["cid"]))
    # A lead is dealt with its pairs to blocks of bounded size, as it may have many.
    part = lambda b, pairs: F.pmod(F.xxhash64(b), F.ceil(pairs / BLOCK_MINOR))
    fewer = written(likely.groupBy("a").agg(F.count("*").alias("pairs")))
    members = join_hot(likely, fewer, ["a"], "pairs", hot).select(F.col("b").alias("cid"), F.col("a").alias("key"), part("b", F.col("pairs")).alias("i"), F.lit(False).alias("q"))
    heads = fewer.select(F.col("a").alias("cid"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("pairs") / BLOCK_MINOR) - 1)).alias("i"), F.lit(True).alias("q"))
    dealt = members.unionByName(heads).join(sets.select("cid", "set"), "cid").select("key", "i", F.lit(0).cast("long").alias("j"), "q", F.col("cid").alias("comp"), "set")
    links = _in_blocks(dealt, percent)
    found = components(links)
    # Buckets that hold several components: classes outside the first one's component against all the others.
    placed = written(shared.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", F.coalesce("component", "cid").alias("comp"), "key"))
    mixed = placed.groupBy("key").agg(
        F.min_by("comp", "cid").alias("lead_comp"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("cid")).alias("who"), F.sum(F.shiftright(F.xxhash64(F.col("cid") + 1), 24)).alias("who2"),
    ).where("members > 2 and c0 <> c1")
    once = mixed.groupBy("members", "who", "who2").agg(F.min_by(F.struct("key", "lead_comp", "total"), "key").alias("v")).select("members", "v.*")
    once = written(once)
    rows = join_hot(placed, once, ["key"], "members", hot).withColumn("minor", F.col("comp") != F.col("lead_comp"))
    minors = rows.where("minor").groupBy("key").agg(F.count("*").alias("n_minor"), F.sum("n").alias("minor_total"))
    # A block is bounded in sets and, single large sets aside, in shingles.
    minor_blocks = F.ceil(F.greatest(F.col("n_minor") / BLOCK_MINOR, F.col("minor_total") / (BLOCK_SHINGLES / 4)))
    all_blocks = F.ceil(F.greatest(F.col("members") / BLOCK_ALL, F.col("total") / BLOCK_SHINGLES))
    plan = written(once.join(minors, "key").select("key", "lead_comp", "members", minor_blocks.alias("minor_blocks"), all_blocks.alias("all_blocks")))
    rows = join_hot(placed, plan, ["key"], "members", hot).withColumn("minor", F.col("comp") != F.col("lead_comp"))
    spread = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    place = lambda blocks: F.pmod(F.xxhash64("cid"), F.col(blocks))
    asked = rows.where("minor").select("cid", "comp", "key", F.lit(True).alias("q"), place("minor_blocks").alias("i"), F.explode(spread("all_blocks")).alias("j"))
    against = rows.select("cid", "comp", "key", F.lit(False).alias("q"), place("all_blocks").alias("j"), F.explode(spread("minor_blocks")).alias("i"))
    blocks = written(asked.unionByName(against))
    joined = components(_in_blocks(blocks.join(sets.select("cid", "set"), "cid").select("key", "i", "j", "q", "comp", "set"), percent))
    final = found.join(joined.toDF("component", "last"), "component", "left").select(F.col("node").alias("cid"), F.coalesce("last", "component").alias("group"))
    alone = joined.join(found.select("node").distinct(), "node", "left_anti").toDF("cid", "group")
    grouped = classes.join(final.unionByName(alone), "cid", "left").select("f1", "f2", "rep", "copies", F.coalesce("group", "cid").alias("group"))
    grouped = written(grouped)
    smallest = grouped.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_classes"))
    smallest = written(smallest)
    named = written(join_hot(grouped, smallest, ["group"], "n_classes", hot).select("f1", "f2", "copies", "group", "component_id"))
    known = join_hot(usable.select("doc_id", "text_key", "n_shingles", "f1", "f2"), named, ["f1", "f2"], "copies", hot)
    blank = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    done = written(known.select("doc_id", "text_key", "n_shingles", "component_id", "group").unionByName(blank))
    forget(signed, classes, first, shared, proposed, per_lead, likely, sets, fewer, links, found, placed, once, plan, blocks, joined, grouped, smallest, named)
    return done


def _in_blocks(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of dealt sets, block by block."""
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(ordered.mapInArrow(block_links(percent), "a long, b long").where("a <> b"))


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows = row_classes(docs, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, of each component one row: of those with the smallest doc_id the one with the least text hash, once."""
    rows = row_classes(docs, width, percent).where("group is not null")
    # Rows with a component's smallest doc_id: several only where that id is repeated.
    least = rows.where("doc_id = component_id").groupBy("group").agg(F.min("text_key").alias("least"))
    ahead = rows.where("doc_id = component_id").join(least, "group").where("text_key <> least").select("doc_id", "text_key")
    gone = rows.where("doc_id <> component_id").select("doc_id", "text_key").unionByName(ahead).toDF("gone_id", "gone_key").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    left = own.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(F.lit(0)))
    counts = F.col("own_id").isNotNull() & F.coalesce(F.col("doc.text").rlike(WORD), F.lit(False))
    left = left.withColumn("nth", nth).where((F.col("nth") == 1) | ~counts)
    return left.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), width=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 3 THEN array_to_string(a, ' ') ELSE a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] END AS x
      FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 2, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node WHERE r.root < b.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT c.node AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.node = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.node
"""
