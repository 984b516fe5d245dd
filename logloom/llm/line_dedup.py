"""Line dedup: a line that several documents hold stays only in the document with the smallest id.

A line's key is the line without blanks at its ends, A-Z in lower case; its 128-bit hash stands for it. Documents are
dealt to parts by a hash of their id, PARTS of them and more as the documents grow, and each part tells of a line's hash its first place (document, position) and
its last document. Those rows, one a part at most of a hash whatever its frequency, are range-partitioned by hash and sorted
by document and position, so that each hash's first occurrence streams past. The verdict goes back to the lines by hash
and part, so no task gets all rows of a frequent line. What comes back per document is a compressed keep bitmap, no
text: words of 64 lines, of which the lowest bit is the first line, and only the words that lack a line.

Defined cases: null or empty text is one empty line; keys shorter than min_chars never count; repeats within the
keeping document stay; rows that repeat a doc_id count as one document, and each row loses its own lines that an earlier
document holds (a row is known by doc_id and a hash of its text); a null doc_id is left as it is; other columns are
carried by dedup_lines() and left out of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, table

MIN_CHARS, BITS = 10, 64
#: Parts at least, and documents in a part at most.
PARTS, PART_ROWS = 1024, 100_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, keep (array of word, bits) of every document that loses lines."""
    parts = max(PARTS, -(-docs.count() // PART_ROWS))
    lines = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.posexplode_outer(_lines(ascii_lower(F.col("text")))).alias("pos", "line")
    )
    key = F.btrim("line", F.lit(BLANKS))
    hashed = lines.where(F.char_length(key) >= min_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "part", "doc_id", "text_key", "pos")
    # A place orders by document, then by position; as a decimal its minimum is kept by hash, without a sort.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")
    local = hashed.groupBy("h1", "h2", "part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min(place).alias("place"))
    by_hash = Window.partitionBy("h1", "h2")
    streamed = local.repartitionByRange("h1", "h2").select(
        "h1", "h2", "part", F.first("first").over(by_hash.orderBy("place", "part")).alias("owner"), F.max("last").over(by_hash).alias("other")
    )
    shared = streamed.where("owner < other").select("h1", "h2", "part", "owner")
    lost = hashed.join(shared, ["h1", "h2", "part"]).where("doc_id <> owner")
    gone = F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})"))
    words = lost.groupBy("doc_id", "text_key", F.expr(f"cast(pos div {BITS} as int)").alias("word")).agg(F.bitwise_not(gone).alias("bits"))
    return words.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with its own columns under `doc`, and n_lines, n_dropped, kept_text."""
    # Rows without doc_id have no bitmap: their key is spread by text.
    own = docs.select(F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own = own.withColumn("known", F.col("doc.doc_id").isNotNull()).withColumn("doc_key", F.coalesce(F.col("doc.doc_id").cast("long"), "text_key"))
    maps = bitmaps.select(F.col("doc_id").cast("long").alias("doc_key"), "text_key", F.lit(True).alias("known"), "keep")
    joined = own.join(maps, ["doc_key", "text_key", "known"], "left").withColumn("line", _lines(F.col("doc.text")))
    unset = lambda w: F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(w["bits"], b) == 0)
    gone = F.flatten(F.transform("keep", lambda w: F.transform(unset(w), lambda b: w["word"] * BITS + b)))
    joined = joined.withColumn("gone", F.when(F.col("keep").isNotNull(), gone))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat("gone", F.array(F.size("line")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("line", a + 1, b - a)))
    return joined.select(
        "doc", F.size("line").cast("long").alias("n_lines"), F.when(F.col("keep").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that an earlier document holds; documents left without a word go, unless they had none."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    left = done.where("n_dropped = 0 or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    text = F.when(F.col("n_dropped") == 0, F.col("doc.text")).otherwise(F.col("kept_text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(F.char_length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, d.owner IS NOT NULL AND d.owner <> k.doc_id AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
