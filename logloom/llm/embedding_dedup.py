"""Near-dedup of embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of a label form a class. Each class is hashed TABLES times: FUNCTIONS rotations (three rounds of sign
flips and a Hadamard transform) each give the nearest of the 2d signed axes; the vector goes to the bucket of its own
axes and to PROBES - 1 more, in which the closest call is changed to its runner-up. A bucket's classes are compared in
blocks of at most about BLOCK rows by one product of matrices in double precision. A pair that meets in several buckets
counts in the first only. A block gives each row's number of links and a spanning set of links, never its pairs.
Components follow by large-star and small-star. A hot vector or bucket meets its rows by a broadcast of bounded size.

Defined cases: a null label or vec_id, a null, empty or zero vector, or null or non-finite components: linked with
nothing; vectors of other lengths are not compared; repeated rows count as vectors of their own, and so do rows that
repeat a vec_id with another vector or label; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hot_from, join_hot, table, written
from .graph import components

TABLES, FUNCTIONS, PROBES, BLOCK = 10, 3, 3, 512
LEAST = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of x in place, a power of two long, not normalised."""
    rows, n = x.shape
    h = 1
    while h < n:
        pairs = x.reshape(rows, n // (2 * h), 2, h)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        less = a - b
        a += b
        b[...] = less
        h *= 2
    return x


def bucket_codes(vectors: np.ndarray) -> np.ndarray:
    """Rows of TABLES * PROBES bucket numbers."""
    n, d = vectors.shape
    width = 1 << max(0, (d - 1).bit_length())
    x = np.zeros((n, width), np.float32)
    v = even(vectors)
    x[:, :d] = v / np.linalg.norm(v, axis=1, keepdims=True)
    signs = np.random.default_rng(2).choice(np.float32([-1, 1]), (TABLES, FUNCTIONS, 3, width))
    scale = np.float32(1 / np.sqrt(width))
    out = np.zeros((n, TABLES, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, second, gap = (np.zeros((n, FUNCTIONS), kind) for kind in (np.int64, np.int64, np.float32))
        for k in range(FUNCTIONS):
            y = x * signs[t, k, 0]
            for r in range(3):
                if r:
                    y *= signs[t, k, r] * scale
                hadamard(y)
            size = np.abs(y)
            a = size.argmax(axis=1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(axis=1) if width > 1 else a
            best[:, k], second[:, k] = 2 * a + (y[rows, a] < 0), 2 * b + (y[rows, b] < 0)
            gap[:, k] = top - size[rows, b]
        close = np.argsort(gap, axis=1, kind="stable")
        for p in range(PROBES):
            code = best.copy()
            if p:
                code[rows, close[:, p - 1]] = second[rows, close[:, p - 1]]
            value = np.full(n, t, np.int64)
            for k in range(FUNCTIONS):
                value = value * (2 * width) + code[:, k]
            out[:, t, p] = value
    return out.reshape(n, -1)


def even(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled by powers of two so that squares neither overflow nor vanish."""
    v = vectors.astype(float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list array, and where each list starts and the last one ends."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False), offsets


def coded(classes: DataFrame) -> DataFrame:
    """cid and codes (array<long>) of every class."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = rows_of(batch.column(1))
            sizes = np.diff(at)
            codes = np.zeros((len(sizes), TABLES * PROBES), np.int64)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for k in range(0, len(own), 2048):
                    part = own[k : k + 2048]
                    codes[part] = bucket_codes(flat[at[part][:, None] + np.arange(d)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, TABLES * PROBES), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "codes"])

    return classes.select("cid", "embedding").mapInArrow(hashed, "cid long, codes array<long>")


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of shared codes (-1 for none): the least code that both have, tables in order."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        own = a[:, k]
        both = (own >= 0) & (b == own[:, None]).any(axis=1)
        np.minimum(out, np.where(both, own, np.iinfo(np.int64).max), out=out)
    return out


def block_links(least: float):
    """For sorted rows of blocks: a, b, links: a's links that first meet here, and b, the least row it is joined with."""

    def compare(code: int, i: int, j: int, cid: np.ndarray, size: np.ndarray, side: np.ndarray, v: np.ndarray, codes: np.ndarray) -> list[tuple]:
        v = even(v)
        norm = np.sqrt((v * v).sum(axis=1))
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        p, q = np.nonzero((v[one] @ v[two].T) / (norm[one][:, None] * norm[two][None, :]) >= least)
        p, q = one[p], two[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        for k in range(0, len(p), 200_000):
            part = slice(k, k + 200_000)
            here = _first_meeting(codes[p[part]], codes[q[part]]) == code
            p[part], q[part] = np.where(here, p[part], -1), np.where(here, q[part], -1)
        p, q = p[p >= 0], q[q >= 0]
        if not len(p):
            return []
        links = np.bincount(p, size[q], len(cid)) + np.bincount(q, size[p], len(cid))
        root = cid.copy()
        while True:
            new = root.copy()
            np.minimum.at(new, p, root[q])
            np.minimum.at(new, q, root[p])
            if (new == root).all():
                break
            root = new
        return [(int(cid[k]), int(root[k]), int(links[k])) for k in np.flatnonzero(links)]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)] if held else []
            if parts and len(parts[0]) > 1 and (found := compare(*key[2:], *parts)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            cid, size, side = (batch.column(k).to_numpy() for k in (5, 6, 7))
            (flat, at), (shared, ends) = rows_of(batch.column(8)), rows_of(batch.column(9))
            codes = np.full((len(keys), TABLES * PROBES), -1, np.int64)
            counts = np.diff(ends)
            codes[np.repeat(np.arange(len(keys)), counts), np.arange(counts.sum()) - np.repeat(ends[:-1] - ends[0], counts)] = shared[ends[0] : ends[-1]]
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])] if keys else []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != key:
                    yield from out()
                    key, held = keys[a], []
                held.append((cid[a:b], size[a:b], side[a:b], flat[at[a] : at[b]].reshape(b - a, -1), codes[a:b]))
        yield from out()

    return linked


def near_vectors(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("embedding"), usable.alias("usable"))
    same = vectors.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = written(same.select(F.monotonically_increasing_id().alias("cid"), "label", "embedding", "rep", "size", F.size("embedding").alias("d"), *_hashes()))
    hashed = written(coded(classes))
    hot = hot_from(vectors.count() * TABLES * PROBES)
    places = hashed.join(classes.select("cid", "label", "d"), "cid").select("cid", "label", "d", F.explode(F.array_distinct("codes")).alias("code"))
    shared = written(places.groupBy("label", "d", "code").agg(F.count("*").alias("members")).where("members > 1"))
    inside = written(join_hot(places, shared, ["label", "d", "code"], "members", hot).select("cid", "label", "d", "code", "members"))
    # The codes that a class shares with others, at most TABLES * PROBES: what two classes first meet in is one of them.
    own_codes = inside.groupBy("cid").agg(F.collect_list("code").alias("shared"))
    full = classes.select("cid", "size", "embedding").join(own_codes, "cid")
    blocks = F.ceil(F.col("members") / BLOCK)
    spread = inside.select("cid", "label", "d", "code", F.pmod(F.xxhash64("cid"), blocks).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = spread.select("cid", "label", "d", "code", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side").join(full, "cid")
    dealt = dealt.select("label", "d", "code", "i", "j", "cid", "size", "side", "embedding", "shared")
    dealt = dealt.repartition("label", "d", "code", "i", "j").sortWithinPartitions("label", "d", "code", "i", "j")
    links = written(dealt.mapInArrow(block_links(least), "a long, b long, links long"))
    found = components(links)
    counts = links.groupBy("a").agg(F.sum("links").alias("others"))
    per_class = classes.select("cid", "label", "h1", "h2", "rep", "size").join(counts, F.col("cid") == F.col("a"), "left").join(found, F.col("cid") == F.col("node"), "left")
    per_class = written(per_class.select("label", "h1", "h2", "rep", "size", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("group")))
    smallest = written(per_class.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")))
    named = written(join_hot(per_class, smallest, ["group"], "classes", hot).select("label", "h1", "h2", "size", "n_links", "component_id"))
    known = join_hot(vectors.where("usable").select("vec_id", "label", *_hashes()), named, ["label", "h1", "h2"], "size", hot).select("vec_id", "n_links", "component_id")
    others = vectors.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = written(known.unionByName(others))
    forget(classes, hashed, shared, inside, links, found, per_class, smallest, named)
    return done.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _hashes():
    """128 bits that stand for a vector."""
    return F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.node AS vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, c.node = c.component_id AS kept FROM c LEFT JOIN k ON k.a = c.node
"""
