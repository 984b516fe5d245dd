"""Responses to requests, one row per request: entries within a budget of characters, pages of hits, pages of files touched.

A response is bounded by its budget or its page, so a row never grows with the session: texts are cut to their share before
the parts of one request meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .drill import OVERHEAD, RESPONSE_MOST
from .recall import HINT

PAGE = 5


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _in_order(order: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def capped(requests: DataFrame, parts: DataFrame, most: int = RESPONSE_MOST, kind: str = "entry") -> DataFrame:
    """request_id, response of requests (request_id, header or null; perhaps most) with their parts (request_id, at, label or null, text).

    The header is charged first, what it leaves is shared equally less an overhead for each part, and the labels of the parts
    that were cut (else kind and place) follow outside the budget. most: 0 leaves everything whole; a column of requests overrides it.
    """
    own = requests.select("request_id", F.coalesce("header", F.lit("")).alias("header"), (F.greatest(F.col("most"), F.lit(0)) if "most" in requests.columns else F.lit(most)).cast("long").alias("most"))
    rows = own.join(parts.select("request_id", "at", "label", F.coalesce("text", F.lit("")).alias("text")), "request_id")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("request_id"))).withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("at")))
    room = F.greatest(F.col("most") - F.char_length("header"), F.lit(0))
    share = F.floor(F.greatest(room - OVERHEAD * F.col("n"), F.lit(0)) / F.col("n"))
    rows = rows.withColumn("whole", (F.col("most") == 0) | (F.char_length("text") <= share)).withColumn("name", F.coalesce("label", _text(kind, " ", F.col("nth"))))
    rows = rows.withColumn("shown", F.when(F.col("whole"), F.col("text")).otherwise(F.substring("text", F.lit(1), share.cast("int"))))
    per = rows.groupBy("request_id").agg(_in_order("nth", "shown", "whole", "name").alias("x"))
    found = own.join(per, "request_id", "left")
    cut = F.filter("x", lambda p: ~p["whole"])
    shown = F.filter(F.concat(F.array("header"), F.coalesce(F.transform("x", lambda p: p["shown"]), F.array().cast("array<string>"))), lambda t: t != "")
    told = _text("\n\n--- recall response capped at ", F.col("most"), " characters; omitted ", kind, F.when(F.size(cut) == 1, "").otherwise("s"), ": ", F.array_join(F.transform(cut, lambda p: p["name"]), ", "), " ---")
    return found.select("request_id", F.concat(F.array_join(shown, "\n\n"), F.when(F.size(F.coalesce(cut, F.array().cast(per.schema["x"].dataType))) > 0, told).otherwise("")).alias("response"))


def _paged(requests: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """requests with page (from 1), n (rows of the request), pages; and the page's own rows as x."""
    own = requests.withColumn("page", F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).cast("long"))
    counts = rows.groupBy("request_id").agg(F.count("*").alias("n"))
    own = own.join(counts, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pages", F.ceil(F.col("n") / size).cast("long"))
    inside = rows.join(own.select("request_id", "page"), "request_id").where(F.col("rn").between((F.col("page") - 1) * size + 1, F.col("page") * size))
    x = inside.groupBy("request_id").agg(_in_order("rn", *[c for c in rows.columns if c not in ("request_id", "rn")]).alias("x"))
    return own.join(x, "request_id", "left")


def pages(requests: DataFrame, hits: DataFrame, size: int = PAGE) -> DataFrame:
    """request_id, response: one page of the hits (request_id, rn, shown, clipped) of requests (request_id, query, page, scope, mode, total).

    total: how many hits there were before the search's cap. A page out of range names the pages there are.
    """
    rows = _paged(requests, hits, size)
    scope = F.when(F.col("scope") == "all", " (scope: all)").otherwise("")
    mode = F.when(F.col("mode") != "hybrid", _text(" with mode:'", F.col("mode"), "'")).otherwise("")
    capped_ = F.col("total") > F.col("n")
    note = F.concat(scope, F.when(capped_, _text(" — showing ", F.col("n"), " of ", F.col("total"), " matches, refine your query for more precise results")).otherwise(""))
    outside = _text("Page ", F.col("page"), " is outside the available range 1-", F.col("pages"), " (", F.col("n"), " matches", note, "). Use a page between 1 and ", F.col("pages"), mode, F.when(capped_, ".").otherwise(", or refine your query."))
    header = F.when(F.col("pages") > 1, _text("Page ", F.col("page"), "/", F.col("pages"), " (", F.col("n"), " total matches", note, ")")).otherwise(_text(F.col("n"), " matches", note))
    body = F.array_join(F.transform("x", lambda h: h["shown"]), "\n\n")
    hint = F.when(capped_ | F.exists("x", lambda h: h["clipped"]), f"\n\n{HINT}").otherwise("")
    footer = F.when(F.col("page") < F.col("pages"), _text("\n--- Use page:", F.col("page") + 1, F.when(F.col("scope") == "all", " with scope:'all'").otherwise(""), mode, " for more results ---")).otherwise("")
    none = _text('No matches for "', F.col("query"), '" in session history.')
    text = F.when(F.col("n") == 0, none).when(F.col("page") > F.col("pages"), outside).otherwise(F.concat(_text(header, ' for "', F.col("query"), '":\n\n'), body, hint, footer))
    return rows.select("request_id", text.alias("response"))


def display_path(path: Column, directory: str | None = None) -> Column:
    """A path from a working directory on, else its last three names behind dots; short ones as they are."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    last = F.when(F.size(F.split(plain, "/")) > 3, F.concat(F.lit(".../"), F.substring_index(plain, "/", -3))).otherwise(plain)
    if directory is None:
        return last
    root = directory.replace("\\", "/")
    return F.when(plain.startswith(root + "/"), F.concat(F.lit("."), F.substring(plain, F.lit(len(root) + 1), F.char_length(plain)))).otherwise(last)


def touched_pages(requests: DataFrame, blocks: DataFrame, directory: str | None = None, size: int = PAGE) -> DataFrame:
    """request_id, response: a page of the files that a session's blocks (session_id, blk, path, name) name, by first appearance,
    with the entries and tools that do; requests: request_id, session_id, page."""
    refs = F.array_join(F.transform(_in_order("blk", "name"), lambda e: _text("#", e["blk"], " (", e["name"], ")")), ", ")
    files = blocks.where("path is not null").groupBy("session_id", "path").agg(F.min("blk").alias("first_blk"), refs.alias("refs"))
    files = files.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("first_blk", "path")))
    rows = _paged(requests, files.join(requests.select("request_id", "session_id"), "session_id").select("request_id", "rn", _text("  ", display_path(F.col("path"), directory), "    ", F.col("refs")).alias("line")), size)
    outside = _text("Page ", F.col("page"), " is outside the available range 1-", F.col("pages"), " (", F.col("n"), " total files). Use page:N with N between 1 and ", F.col("pages"), ".")
    header = F.when(F.col("pages") > 1, _text("Page ", F.col("page"), "/", F.col("pages"), " (", F.col("n"), " total files)")).otherwise(_text(F.col("n"), " files touched"))
    footer = F.when(F.col("page") < F.col("pages"), _text("\n\n--- Use page:", F.col("page") + 1, " for more results ---")).otherwise("")
    text = F.when(F.col("n") == 0, "No file operations found in session history.").when(F.col("page") > F.col("pages"), outside)
    return rows.select("request_id", text.otherwise(F.concat(header, F.lit(":\n\n"), F.array_join(F.transform("x", lambda f: f["line"]), "\n"), footer)).alias("response"))
