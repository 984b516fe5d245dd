"""From a hit to its source: windows of lines of entries and files, and the messages that omissions stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relevance import safe_pattern
from ..functions.text import clip, clip_bytes, line_snippet

PREVIEW_LINES, FULL_BYTES, SNIPPET_MOST = 30, 50 * 1024, 2000
RESPONSE_MOST, OVERHEAD = 48_000, 200


def line_window(text: Column, offset: Column, limit: Column) -> Column:
    """struct of first_line, last_line (from 1; none beyond the end), total_lines and shown: lines from an offset on; a
    limit that is missing or not positive means a preview's length."""
    lines = F.split(text, "\n")
    start = F.greatest(F.coalesce(offset, F.lit(0)), F.lit(0))
    most = F.when(limit > 0, limit).otherwise(PREVIEW_LINES)
    end = F.least(start + most, F.size(lines))
    inside = start < F.size(lines)
    shown = F.when(inside, F.array_join(F.slice(lines, F.when(inside, start + 1).otherwise(1), F.when(inside, end - start).otherwise(0)), "\n"))
    return F.struct(F.when(inside, start + 1).alias("first_line"), F.when(inside, end).alias("last_line"), F.size(lines).alias("total_lines"), shown.alias("shown"))


def expand_files(operations: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, session_id, source, pattern, full, offset, limit) with n_matches and paths of the file
    operations of that message whose path holds the pattern ('file': all of them), and where one matches its path, tool
    and window of lines; full: up to 50 KiB in whole characters.
    """
    o, r = operations.alias("o"), requests.alias("r")
    hit = (F.col("o.session_id") == F.col("r.session_id")) & (F.col("o.source") == F.col("r.source")) & ((F.col("r.pattern") == "file") | F.contains("o.path", F.col("r.pattern")))
    found = r.join(o, hit, "left").groupBy("r.request_id", "r.session_id", "r.source", "r.pattern", "r.full", "r.offset", "r.limit")
    rows = found.agg(F.count("o.path").alias("n_matches"), F.array_join(F.array_sort(F.collect_list("o.path")), ",").alias("paths"), F.min_by(F.struct("o.path", "o.name", "o.body"), "o.blk").alias("one"))
    only = F.when(F.col("n_matches") == 1, F.col("one.body"))
    view = line_window(only, F.col("offset"), F.col("limit"))
    shown = F.when(F.col("full"), clip_bytes(only, FULL_BYTES)).otherwise(view["shown"])
    return rows.select("request_id", "n_matches", "paths", F.when(only.isNotNull(), F.col("one.path")).alias("path"), F.when(only.isNotNull(), F.col("one.name")).alias("tool"), F.when(only.isNotNull(), view["total_lines"]).alias("total_lines"), shown.alias("shown"))


def file_hits(operations: DataFrame, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """File operations whose path or content matches, whatever its case (all without a pattern): session_id, source, path, name,
    n_lines, snippet. most: the first so many of each session, in order."""
    if pattern is None:
        hits = operations.select("session_id", "source", "blk", "path", "name", "n_lines", clip(F.col("searched"), SNIPPET_MOST).alias("snippet"))
    else:
        found = "(?iu)" + safe_pattern(pattern)
        n = F.size(F.filter(F.split("searched", "\n"), lambda x: x.rlike(found) & ~x.rlike(r"^\s*$")))
        snippet = clip(F.coalesce(line_snippet(F.col("searched"), found, 1), F.col("path")), SNIPPET_MOST)
        hits = operations.where(F.col("searched").rlike(found)).select("session_id", "source", "blk", "path", "name", n.alias("n_lines"), snippet.alias("snippet"))
    if most is not None:
        place = F.dense_rank().over(Window.partitionBy("session_id").orderBy("source"))
        hits = hits.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return hits.drop("blk")


def omission_targets(omissions: DataFrame, messages: DataFrame) -> DataFrame:
    """omissions (session_id, entry_id, call_id, serialized) with target: the place of the one message of the session with
    the same entry_id, else the same call_id, else the same serialized text (by digest); null where none is unique.
    """
    keys = {"entry_id": lambda c: c, "call_id": lambda c: F.when(c != "", c), "serialized": lambda c: F.sha2(c, 256)}
    rows = omissions
    for name, key in keys.items():
        unique = messages.select("session_id", key(F.col(name)).alias(f"k_{name}"), "place").where(F.col(f"k_{name}").isNotNull())
        unique = unique.groupBy("session_id", f"k_{name}").agg(F.count("*").alias("n"), F.min("place").alias(f"at_{name}")).where("n = 1").drop("n")
        rows = rows.withColumn(f"k_{name}", key(F.col(name))).join(unique, ["session_id", f"k_{name}"], "left").drop(f"k_{name}")
    return rows.withColumn("target", F.coalesce(*[F.col(f"at_{k}") for k in keys])).drop(*[f"at_{k}" for k in keys])


def with_chain(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """session_id, place, part, text: messages (session_id, place, text, summary: whether it is the compaction's) with the
    one summary replaced by the segments (session_id, sequence, summary) of the chain; where there is not exactly one, as they are.
    """
    ones = messages.where("summary").groupBy("session_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    chained = segments.join(ones, "session_id", "left_semi").select("session_id", "sequence", F.col("summary").alias("segment"))
    known = chained.select("session_id").distinct().withColumn("chained", F.lit(True))
    rows = messages.join(known, "session_id", "left")
    plain = rows.where("not summary or chained is null").select("session_id", "place", F.lit(0).cast("long").alias("part"), "text")
    swapped = rows.where("summary and chained").select("session_id", "place").join(chained, "session_id").select("session_id", "place", F.col("sequence").cast("long").alias("part"), F.col("segment").alias("text"))
    return plain.unionByName(swapped)


#: What stands before and behind a summary that a model reads as a message.
FRAME_OPEN = "Prior model work/tool state available.\nMUST build on prior work; NEVER duplicate prior work.\n\n<summary>\n"
FRAME_CLOSE = "\n</summary>"
SUMMARIES = ("compactionSummary", "branchSummary")


def projected(messages: DataFrame, segments: DataFrame, chains: DataFrame) -> DataFrame:
    """session_id, place, part, role, text of messages (session_id, place, role, text) with the one summary of each chain replaced.

    chains (session_id, trailing): the newest summary's text. The message with a summary's role and exactly that text gives way to
    the chain's segments (session_id, sequence, summary) and the trailing text, one frame around them all, as hidden
    messages. Where no message or several have it, nothing changes; so a second pass changes nothing either.
    """
    told = chains.where("trailing <> ''").groupBy("session_id").agg(F.max("trailing").alias("trailing"))
    rows = messages.join(told, "session_id", "left").withColumn("hit", F.coalesce(F.col("role").isin(*SUMMARIES) & (F.col("text") == F.col("trailing")), F.lit(False)))
    rows = rows.withColumn("one", F.count_if("hit").over(Window.partitionBy("session_id")) == 1)
    plain = rows.where("not (hit and one)").select("session_id", "place", F.lit(0).cast("long").alias("part"), "role", "text")
    at = rows.where("hit and one").select("session_id", "place", "trailing")
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("sequence")) == 1
    lead = segments.select("session_id", F.col("sequence").cast("long").alias("part"), F.when(first, F.concat(F.lit(FRAME_OPEN), "summary")).otherwise(F.col("summary")).alias("text"))
    any_ = segments.select("session_id").distinct().withColumn("some", F.lit(True))
    last = at.join(any_, "session_id", "left").select("session_id", "place", F.lit(2**62).alias("part"), F.lit("append-trailing").alias("role"), F.concat(F.when(F.col("some"), "").otherwise(FRAME_OPEN), "trailing", F.lit(FRAME_CLOSE)).alias("text"))
    swapped = at.select("session_id", "place").join(lead, "session_id").select("session_id", "place", "part", F.lit("append-segment").alias("role"), "text")
    return plain.unionByName(swapped).unionByName(last)


def allotted(rows: DataFrame, key: str, text: str, most: int = RESPONSE_MOST) -> DataFrame:
    """rows with shown and cut: every text of a key gets an equal share of the response, less an overhead for each."""
    n = F.count("*").over(Window.partitionBy(key))
    share = F.floor(F.greatest(F.lit(most) - OVERHEAD * n, F.lit(0)) / n).cast("int")
    return rows.withColumn("share", share).withColumn("shown", F.substring(F.col(text), F.lit(1), F.col("share"))).withColumn("cut", F.char_length(text) > F.col("share")).drop("share")


