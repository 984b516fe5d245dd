"""Requests to a log: references to entries and files, options within the text, and results as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_W, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: The forms of references and options.
ENTRY = r"^#(\d+)(?::(full|\d+(?::\d+)?))?\z"
ENTRY_TEXT = r"^#(\d+):text(?::(full|\d+(?::\d+)?))?\z"
FILE = r"^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?\z"
SCOPE = rf"(?i){_W}scope:(lineage|all|active){_E}"
MODE = rf"(?i){_W}mode:(hybrid|touched|file){_E}"
PAGE = rf"(?i){_W}page:(\d+){_E}"
KEEP = rf"(?i){_W}keep:(\d+){_E}"
HINT = "--- Use #N for full entry text ---"
TOP_FILES = 10


def reference(query: Column) -> Column:
    """struct of kind (entry, text, file, or search for any other query), index, pattern, full, offset, limit.

    An entry (#N) is tried first, then its text (#N:text), then a file of it (#N:path), each with :full, :offset or
    :offset:limit after it.
    """
    form = F.when(query.rlike(ENTRY), "entry").when(query.rlike(ENTRY_TEXT), "text").when(query.rlike(FILE), "file").otherwise("search")
    of = lambda *groups: F.when(form == "entry", groups[0]).when(form == "text", groups[1]).when(form == "file", groups[2])
    suffix = of(F.regexp_extract(query, ENTRY, 2), F.regexp_extract(query, ENTRY_TEXT, 2), F.regexp_extract(query, FILE, 3))
    number = lambda i: F.try_element_at(F.split(suffix, ":"), F.lit(i)).try_cast("long")
    return F.struct(
        form.alias("kind"), F.regexp_extract(query, r"^#(\d+)", 1).try_cast("long").alias("index"), F.when(form == "file", F.regexp_extract(query, FILE, 2)).alias("pattern"),
        F.when(form != "search", suffix == "full").alias("full"), number(1).alias("offset"), number(2).alias("limit"),
    )


def _without(text: Column, pattern: str, by: str = " ") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, by), r"\s+", " "))


def options(text: Column) -> Column:
    """struct of query, scope (all or lineage), mode (hybrid, touched, file) and page: every option is taken out of the text."""
    rest = _without(_without(_without(text, SCOPE, ""), MODE, ""), PAGE)
    found = lambda p: F.lower(F.regexp_extract(text, p, 1))
    page = F.greatest(F.coalesce(F.regexp_extract(_without(_without(text, SCOPE, ""), MODE, ""), PAGE, 1).try_cast("long"), F.lit(1)), F.lit(1))
    mode = F.when(found(MODE) != "", found(MODE)).otherwise("hybrid")
    return F.struct(rest.alias("query"), F.when(found(SCOPE) == "all", "all").otherwise("lineage").alias("scope"), mode.alias("mode"), page.alias("page"))


def keep_options(text: Column) -> Column:
    """struct of prompt, keep (of the last keep:N; none without one) and explicit."""
    text = F.trim(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(text, F.lit(KEEP), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.struct(F.when(F.size(found) > 0, _without(text, KEEP)).otherwise(text).alias("prompt"), F.coalesce(last.try_cast("long"), F.when(last.isNotNull(), 2**53 - 1)).alias("keep"), (F.size(found) > 0).alias("explicit"))


def requested(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (session_id, at, idx) once each, with the columns of entries (session_id, idx, ...) and `available`.

    at is a request's place; rows that are not available name indices that nothing can expand.
    """
    once = requests.groupBy("session_id", "idx").agg(F.min("at").alias("at"))
    return once.join(entries.withColumn("found", F.lit(True)), ["session_id", "idx"], "left").withColumn("available", F.coalesce("found", F.lit(False))).drop("found")


def unavailable(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """session_id, at, idx of requests for indices that the entries don't have, once each."""
    once = requests.groupBy("session_id", "idx").agg(F.min("at").alias("at"))
    return once.join(entries.select("session_id", "idx"), ["session_id", "idx"], "left_anti").select("session_id", "at", "idx")


def hit_text(index: Column, role: Column, files: Column, matches: Column, body: Column) -> Column:
    """One hit as text: number, role, files, then matches of files (path, tool, n_lines, snippet) or the body beside it."""
    indented = lambda m: F.concat(F.lit("\n"), F.array_join(F.transform(F.split(m["snippet"], "\n"), lambda x: F.concat(F.lit("    "), x)), "\n"))
    line = lambda m: F.concat(F.lit("  "), m["path"], F.lit(" ("), m["tool"], F.lit(", "), m["n_lines"].cast("string"), F.lit(" lines)"), F.when(F.coalesce(m["snippet"], F.lit("")) != "", indented(m)).otherwise(""))
    listed = F.size(F.coalesce(matches, F.array().cast("array<struct<path:string,tool:string,n_lines:int,snippet:string>>"))) > 0
    named = F.when(F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" files:["), F.array_join(files, ", "), F.lit("]"))).otherwise("")
    details = F.when(listed, F.concat(F.lit("\n"), F.array_join(F.transform(matches, line), "\n"), F.lit("\n"))).otherwise(" ")
    return F.concat(F.lit("#"), index.cast("string"), F.lit(" ["), role, F.lit("]"), named, details, body)


def output(hits: DataFrame, query: str | None = None, title: str | None = None, truncated: bool = False) -> DataFrame:
    """One row: all hits (place, shown, clipped) under a header, with a hint where some are cut. For a page of results: the
    hits are gathered in one row.
    """
    per = hits.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]), "\n\n").alias("body"), F.coalesce(F.bool_or("clipped"), F.lit(False)).alias("clipped"))
    n = F.col("n").cast("string")
    if title is not None:
        header = F.lit(f'{title} for "{query}":')
    else:
        header = F.concat(F.lit("Found "), n, F.lit(f' matches for "{query}":')) if query else F.concat(F.lit("Session history ("), n, F.lit(" entries):"))
    none = F.lit(f'No matches for "{query}" in session history.' if query else "No entries in session history.")
    hint = F.when(F.col("clipped") | F.lit(truncated), f"\n\n{HINT}").otherwise("")
    return per.select(F.when(F.col("n") == 0, none).otherwise(F.concat(header, F.lit("\n\n"), F.col("body"), hint)).alias("output"))


def top_files(blocks: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """session_id, path, nth: the first paths that calls name, in order of appearance."""
    first = blocks.where("kind = 'tool_call' and path is not null").groupBy("session_id", "path").agg(F.min("blk").alias("blk"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("blk", "path"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("session_id", "path", "nth")


def append_metrics(metrics: DataFrame, folder: str) -> None:
    """Metrics rows added to a folder of JSON lines; each call adds files of its own, so nothing is rotated."""
    metrics.write.mode("append").json(folder)


def snapshot(rows: DataFrame, folder: str) -> None:
    """The newest state as JSON, in place of the one before."""
    rows.write.mode("overwrite").json(folder)
