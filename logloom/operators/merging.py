"""Summaries merged as text: what a previous summary says is read back from its lines, whatever broke them, and rendered anew.

Sections are read from the part before the first rule. Their lines may be wrapped: an indented line continues the one before
it, after a backslash without a blank. File lines have three forms, a plain list, one without the directory that all share, and a
directory's overflow; commas within paths are escaped. Lines that only count files carry no names and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brief as T
from ..functions import text as X
from . import brief, summary, windows

#: Categories in order, and the forms of their lines.
CATEGORIES = ("Modified", "Created", "Read")
FILE_LINE = r"^- (Modified|Created|Read)(?:: | \(in (.*?)\): | \(\+\d+ more(?: under (.+?))?\): )([\s\S]*)$"
BARE_COUNT = r"\s*\(\+\d+ more\)\s*\z"


def joined_lines(text: Column) -> Column:
    """Lines with their continuations: an indented line joins the one before it, in place of a backslash at its end or after a blank."""
    bare = F.regexp_replace(text, r"(\n[^\S\n]+\S[^\n]*?)[^\S\n]+(?=\n|\z)", "$1")
    hard = F.regexp_replace(bare, r"\\\n[^\S\n]+(?=\S)", "")
    return F.split(F.regexp_replace(hard, r"\n[^\S\n]+(?=\S)", " "), "\n")


def section(text: Column, title: str) -> Column:
    """A section with its title, tags of skills collapsed line by line; empty where the summary has none."""
    body = summary.section_of(text, title)
    lines = F.array_join(F.transform(F.split(body, "\n"), T.collapsed_skill_tags), "\n")
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"[{title}]\n"), lines)).otherwise("")


def bullets(part: Column) -> Column:
    """The bulleted lines of a section, whole."""
    return F.filter(joined_lines(part), lambda x: x.startswith("- "))


def brief_of(text: Column) -> Column:
    """What follows the sections: all after the first rule; of a text without sections all of it."""
    rule = F.locate(summary.RULE, text)
    head = F.when(rule > 0, F.substring(text, F.lit(1), rule - 1)).otherwise(text)
    titles = "|".join(summary.TITLES.values())
    titled = head.rlike(rf"(?:^|\n)\[(?:{titles})\]")
    after = F.when(rule > 0, F.substring(text, rule + len(summary.RULE), F.char_length(text))).otherwise("")
    return X.trim_blank(F.when(titled, after).otherwise(text))


def file_rows(summaries: DataFrame) -> DataFrame:
    """session_id, category, path, first_blk (its place) of the files that summaries (session_id, summary) name, each once."""
    lines = summaries.select("session_id", F.posexplode(joined_lines(section(F.col("summary"), summary.TITLES["files"]))).alias("nth", "line")).where(F.col("line").rlike(FILE_LINE))
    of = lambda i: F.regexp_extract("line", FILE_LINE, i)
    under = of(3)
    prefix = F.when(of(2) != "", of(2)).when((under != "") & ~under.endswith("/"), F.concat(under, F.lit("/"))).otherwise(under)
    rows = lines.select("session_id", "nth", of(1).alias("category"), prefix.alias("prefix"), F.posexplode(X.split_escaped(F.regexp_replace(of(4), BARE_COUNT, ""))).alias("at", "name"))
    placed = rows.select("session_id", "category", F.concat("prefix", "name").alias("path"), (F.col("nth").cast("long") * 2**20 + F.col("at")).alias("first_blk"))
    return placed.groupBy("session_id", "category", "path").agg(F.min("first_blk").alias("first_blk"))


def file_section(files: DataFrame) -> DataFrame:
    """session_id, files: the section that category_lines gives, categories in order."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    lines = summary.category_lines(files).withColumn("c", place)
    told = F.transform(F.array_sort(F.collect_list(F.struct("c", "nth", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    return lines.groupBy("session_id").agg(F.concat(F.lit(f"[{summary.TITLES['files']}]\n"), F.array_join(told, "\n")).alias("files"))


def _merged_lines(title: str, old: Column, new: Column, most: int, pinned: bool) -> Column:
    lines = windows.merged_lines(bullets(old), bullets(new), most, pinned)
    both = F.when(F.size(lines) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(lines, "\n"))).otherwise("")
    return F.when(old == "", new).when(new == "", old).otherwise(both)


def merged_summaries(previous: DataFrame, fresh: DataFrame, note: bool = True) -> DataFrame:
    """session_id, summary: a previous summary (session_id, summary) and a fresh one as one; sessions with either as they are.

    Goals, commits and preferences keep their newest lines once, goals their very first one too; fresh blockers replace older
    ones, which stay where there are none; files are read back and rendered anew; briefs share one limit of lines.
    """
    old = previous.select("session_id", summary.without_note(F.col("summary")).alias("old"))
    both = fresh.select("session_id", summary.without_note(F.col("summary")).alias("new")).join(old, "session_id", "full_outer")
    none = lambda c: F.coalesce(c, F.lit(""))
    parts = both.select("session_id", *[section(none(F.col(side)), t).alias(f"{side}_{n}") for n, t in summary.TITLES.items() for side in ("old", "new")], brief_of(none(F.col("old"))).alias("old_brief"), brief_of(none(F.col("new"))).alias("new_brief"))
    files = file_section(summary.merged_files(file_rows(previous), file_rows(fresh)))
    rows = parts.join(files, "session_id", "left")
    made = {n: _merged_lines(summary.TITLES[n], F.col(f"old_{n}"), F.col(f"new_{n}"), most, n == "goals") for n, most in summary.MERGED_MOST.items()}
    made["blockers"] = F.when(F.col("new_blockers") != "", F.col("new_blockers")).otherwise(F.col("old_blockers"))
    made["files"] = F.when(F.col("old_files") == "", F.col("new_files")).otherwise(none(F.col("files")))
    top = F.nullif(F.array_join(F.filter(F.array(*[made[n] for n in summary.TITLES]), lambda x: x != ""), "\n\n"), F.lit(""))
    body = F.concat_ws(summary.RULE, top, F.nullif(brief.merged_brief(F.col("old_brief"), F.col("new_brief")), F.lit("")))
    text = F.when(body == "", "").otherwise(F.concat(T.wrapped(body), F.lit(summary.RULE + summary.NOTE if note else "")))
    return rows.select("session_id", text.alias("summary"))
