"""Chat formatting: logged conversations that another one continues go, the rest are rendered turn by turn.

Every turn of a conversation gets a rolling hash of all turns up to it (sums of hashes of position, role and text: a
running sum, so no conversation is gathered into one row). A conversation goes if a longer one has its last hash at the
same position (anti-join), or if an equal one has a smaller conv_id. Rendering gives one row per turn with its text
between markers, and the place of that piece in the conversation's rendering, so a writer can join pieces of any length.

Turns are range-partitioned by conversation, turn, role and text and written once, in order; a conversation's turns in
one partition are a block, and prefix sums over the blocks give positions, places and hashes, so one conversation may
hold any number of rows. All but the last join sees hashes and positions only. Turns follow by turn, then role and text;
a turn's position is its rank.

Defined cases: null role or text count as empty text in the rendering and differ from an empty one in the hash; a null
turn comes first, as if it were turn -1; rows without conv_id go; repeated rows are turns of their own; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, table, written

#: 40-bit hashes: their sums stay exact for 2**23 turns.
_BITS = 24


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, block, ord (order within the block), turn, role, text, chars (of the rendering), t1 and t2 (hashes)."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    own = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("at"), "turn", "role", "text", F.char_length(piece()).cast("long").alias("chars"),
        F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(7), *parts).alias("t2"),
    )
    order = ["conv_id", "at", "role", "text"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("block", F.spark_partition_id()).withColumn("ord", F.monotonically_increasing_id()).drop("at")


def piece() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))


def _before(rows: DataFrame, **sums: str) -> DataFrame:
    """conv_id, block and, of each sum over a block's rows, what the conversation's earlier blocks hold."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(F.expr(x)).alias(n) for n, x in sums.items()])
    return totals.select("conv_id", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def rolling(placed: DataFrame) -> DataFrame:
    """conv_id, block, ord, position (from 1), start (of the piece), r1 and r2 (hash of all turns up to it) of ordered turns."""
    narrow = placed.select("conv_id", "block", "ord", "chars", "t1", "t2")
    upto = Window.partitionBy("conv_id", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ranked = narrow.withColumn("rank", F.row_number().over(upto)).withColumn("cum", F.sum("chars").over(upto))
    ranked = ranked.join(_before(narrow, n0="1", c0="chars"), ["conv_id", "block"])
    ranked = ranked.select("conv_id", "block", "ord", (F.col("rank") + F.col("n0")).alias("position"), (F.col("c0") + F.col("cum") - F.col("chars")).alias("start"), "t1", "t2")
    short = lambda t: F.shiftrightunsigned(F.xxhash64("position", t), _BITS)
    hashed = ranked.select("conv_id", "block", "ord", "position", "start", short("t1").alias("h1"), short("t2").alias("h2"))
    summed = hashed.withColumn("s1", F.sum("h1").over(upto)).withColumn("s2", F.sum("h2").over(upto)).join(_before(hashed, o1="h1", o2="h2"), ["conv_id", "block"])
    return summed.select("conv_id", "block", "ord", "position", "start", (F.col("s1") + F.col("o1")).alias("r1"), (F.col("s2") + F.col("o2")).alias("r2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that stay."""
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("position", "r1", "r2")).alias("end")).select("conv_id", "end.*")
    one = last.groupBy("position", "r1", "r2").agg(F.min("conv_id").alias("conv_id"))
    # Prefixes: every position but the last of a conversation.
    ends = last.select("conv_id", F.col("position").alias("n"))
    prefixes = rolled.select("conv_id", "position", "r1", "r2").join(ends, "conv_id").where("position < n").select("position", "r1", "r2").distinct()
    return one.join(prefixes, ["position", "r1", "r2"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, position, turn, role, start, rendered for every turn of the conversations that stay."""
    placed = written(ordered(turns))
    rolled = written(rolling(placed))
    kept = written(rolled.join(maximal(rolled), "conv_id").select("block", "ord", "n_turns", "position", "start"))
    forget(rolled)
    # A row is known by its order: this join spreads a conversation of any length.
    return placed.join(kept, ["block", "ord"]).select(
        "conv_id", "n_turns", F.col("position").cast("long").alias("position"), "turn", "role", F.col("start").cast("long").alias("start"), piece().alias("rendered")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH p AS (SELECT *, row_number() OVER o AS position, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS piece
           FROM conversations WHERE conv_id IS NOT NULL WINDOW o AS (PARTITION BY conv_id ORDER BY coalesce(turn, -1), role NULLS FIRST, text NULLS FIRST)),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY position) AS a, count(*) AS n FROM p GROUP BY conv_id),
f AS (SELECT DISTINCT list_slice(a, 1, k) AS a FROM (SELECT a, unnest(range(1, n)) AS k FROM c)),
m AS (SELECT a, min(conv_id) AS conv_id, min(n) AS n_turns FROM c GROUP BY a),
s AS (SELECT m.conv_id, m.n_turns FROM m ANTI JOIN f ON m.a = f.a)
SELECT p.conv_id, s.n_turns, p.position, p.turn, p.role,
       (sum(length(p.piece)) OVER (PARTITION BY p.conv_id ORDER BY p.position ROWS UNBOUNDED PRECEDING) - length(p.piece))::BIGINT AS start, p.piece AS rendered
FROM p JOIN s ON p.conv_id = s.conv_id
"""
