"""Mixing sources to target weights, exact to the word.

Every row gets a random key (MD5 of seed and doc_id). Within each source the keys are ranged into buckets of equal
width; sums per bucket give each bucket's start, and a running sum inside the bucket each row's, so no task holds more
than one bucket. A source's budget is cut exactly: whole epochs first, then rows in key order, the last one in part.

Targets share the sum of all sizes by weight (WEIGHTS in turn, by code point of the source, null last). None exceeds
`most` times its source's size; what is cut off is shared again by weight among the others, found in one pass over the
sources ordered by the share at which each reaches its limit.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own; rows that repeat a
doc_id are rows of their own; rows without doc_id are ordered by a hash of their text; an empty table gives an empty
result; other columns are left out of plan_mix(). The windows over all sources see one small row per source in one task.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Buckets of one source: hexadecimal digits of the key, 4096 buckets at least, and rows in one of a source that has them all.
DIGITS, BUCKET_ROWS = 3, 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    # A source is at its limit if the share per weight that is left for it and all later ones exceeds its own limit.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    limit = (most * F.col("source_size")).cast("double")
    taken = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    ranked = weighed.select("source", "source_size", "weight", limit.alias("limit"), ((total - taken) / left).alias("share"), F.row_number().over(order).alias("at"))
    free = F.min(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.struct("at", "share"))).over(Window.partitionBy())
    share = ranked.withColumn("free", free)
    target = F.when(F.col("at") < F.col("free.at"), F.col("limit")).otherwise(F.coalesce(F.col("free.share") * F.col("weight"), F.col("limit")))
    return share.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64("text").cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(seed), own))
    sizes = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    digits = max(DIGITS, ceil(log(max(1, sizes.count() / BUCKET_ROWS), 16)))
    sizes = sizes.withColumn("bucket", F.substring("key", 1, digits))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = sums.select("source", "bucket", (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("start"))
    per_bucket = starts.alias("b").join(source_targets(sizes, weights, most).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    per_bucket = per_bucket.select("b.source", "b.bucket", "start", "source_size", "target")
    # Hash keys spread a source evenly over its buckets, so a hot source is dealt to as many tasks as it has buckets.
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    running = sizes.select("*", (F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inner"))
    joined = running.alias("d").join(per_bucket.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inner")))
    return joined.select("doc_id", "d.source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs as the mix has them: each row once per epoch that takes it, the row at a source's cut up to its last word."""
    plan = plan_mix(docs, seed).where("taken > 0").select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "taken")
    # Rows that repeat a doc_id may be cut apart: match them in order.
    same = Window.partitionBy("plan_id", "plan_source", "plan_size").orderBy(F.desc("taken"))
    plan = plan.withColumn("nth", F.row_number().over(same))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), size.alias("own_size"))
    own = own.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_source", "own_size").orderBy(F.xxhash64("doc.text"))))
    on = F.col("own_id").eqNullSafe(F.col("plan_id")) & F.col("own_source").eqNullSafe(F.col("plan_source")) & (F.col("own_size") == F.col("plan_size")) & (F.col("own_nth") == F.col("nth"))
    copies = own.join(plan, on).select("doc", "own_size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("own_size")))).alias("epoch"))
    words = F.col("taken") - (F.col("epoch") - 1) * F.col("own_size")
    cut = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    copies = copies.withColumn("mixed", F.when(words >= F.col("own_size"), F.col("doc.text")).otherwise(cut))
    made = {"text": F.col("mixed")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(words >= F.col("own_size"), F.col("doc.n_chars")).otherwise(F.char_length("mixed")).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, (3 * source_size)::DOUBLE AS lim, row_number() OVER o AS nth,
      (sum(source_size) OVER ()::DOUBLE - coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT nth AS free_at, share AS free_share FROM r WHERE share * weight <= lim ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN nth < free_at THEN lim ELSE coalesce(free_share * weight, lim) END AS target FROM r LEFT JOIN f ON true),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
      CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM c
"""
