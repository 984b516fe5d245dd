"""Summaries of sessions: files by category, sections, the whole text, and a report on what it keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import brief as T
from ..functions import text as X
from ..sources import messages as M
from ..sources.shared import written
from . import blocks as B
from . import brief, facts, many, windows

SHOWN, NAMED = 20, 100
#: Tools that read or write files, titles in order, and the note at the end.
READS = ("read", "read_file", "view")
WRITES = ("edit", "write", "edit_file", "write_file", "multiedit", "quick_edit", "target_edit", "apply_patch")
TITLES = {"goals": "Session Goal", "files": "Files And Changes", "commits": "Commits", "blockers": "Outstanding Context", "preferences": "User Preferences"}
PROBES = ("goal", "file", "problem")
RULE = "\n\n---\n\n"
NOTE = "Use the recall search for prior work, decisions, and context from before this summary. Do not redo work already completed."


def touched_files(blocks: DataFrame, host: DataFrame | None = None) -> DataFrame:
    """session_id, category (Modified, Created, Read), path, first_blk.

    host (session_id, category, path), where the host knows files: they come before those of calls. Only it tells created
    files; of these the ones that are modified as well go.
    """
    tool = F.lower("name")
    category = F.when(tool.isin(*WRITES), "Modified").when(tool.isin(*READS), "Read")
    calls = blocks.where("kind = 'tool_call' and path is not null").select("session_id", category.alias("category"), "path", "blk").where("category is not null")
    if host is not None:
        known = host.where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").rlike(M.URI))
        calls = calls.unionByName(known.select("session_id", "category", "path", F.lit(-1).cast("long").alias("blk")))
    return created_unmodified(calls.groupBy("session_id", "category", "path").agg(F.min("blk").alias("first_blk")))


def created_unmodified(files: DataFrame) -> DataFrame:
    modified = files.where("category = 'Modified'").select("session_id", "path", F.lit("Created").alias("category"))
    return files.join(modified, ["session_id", "path", "category"], "left_anti").select("session_id", "category", "path", "first_blk")


def merged_files(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Files (session_id, category, path, first_blk) of a previous summary and a fresh one, each once, previous ones first."""
    old = previous.select("session_id", "category", "path", F.struct(F.lit(0).alias("side"), "first_blk").alias("at"))
    new = fresh.select("session_id", "category", "path", F.struct(F.lit(1).alias("side"), "first_blk").alias("at"))
    once = old.unionByName(new).groupBy("session_id", "category", "path").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("session_id", "category").orderBy("at", "path"))
    return created_unmodified(once.select("session_id", "category", "path", place.cast("long").alias("first_blk")))


#: The most lines of a merged section.
MERGED_MOST = {"goals": 8, "commits": 8, "preferences": 15}


def merged_sections(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sections (session_id, goals, commits, blockers, preferences: arrays of lines; brief: text) of a previous summary and a fresh one.

    Lines are kept once, the newest of them, goals with their very first one; fresh blockers replace older ones, which stay
    where there are none; briefs share one limit of lines, and what either loses is said.
    """
    names = ["goals", "commits", "blockers", "preferences", "brief"]
    old = previous.select("session_id", *[F.col(n).alias(f"old_{n}") for n in names])
    both = fresh.join(old, "session_id", "full_outer")
    lines = lambda n: F.transform(F.coalesce(n, F.array().cast("array<string>")), T.collapsed_skill_tags)
    made = {n: windows.merged_lines(lines(f"old_{n}"), lines(n), most, n == "goals") for n, most in MERGED_MOST.items()}
    made["blockers"] = F.when(F.size(lines("blockers")) > 0, lines("blockers")).otherwise(lines("old_blockers"))
    made["brief"] = brief.merged_brief(F.col("old_brief"), F.col("brief"))
    return both.select("session_id", *[made[n].alias(n) for n in names])


def category_lines(files: DataFrame) -> DataFrame:
    """session_id, category, nth, line: the first paths in one line, without the directory that all share; the next by
    directory; the rest as a number. Commas in paths are escaped.
    """
    whole = files.select(F.struct("session_id", "category").alias("session_id"), "path")
    shared = B.common_directory(whole).select("session_id.*", "dir")
    per = Window.partitionBy("session_id", "category")
    rows = files.withColumn("at", F.row_number().over(per.orderBy("first_blk", "path"))).withColumn("n", F.count("*").over(per)).where(F.col("at") <= NAMED)
    rows = rows.join(shared, ["session_id", "category"], "left").withColumn("dir", F.coalesce("dir", F.lit("")))
    own = F.regexp_extract("path", r"^([\s\S]*/)", 1)
    flat = F.col("at") <= SHOWN
    rows = rows.withColumn("group", F.when(~flat, own)).withColumn("name", X.escape_commas(F.expr("substring(path, char_length(CASE WHEN at > 20 THEN regexp_extract(path, '^([\\\\s\\\\S]*/)', 1) WHEN startswith(path, dir) THEN dir ELSE '' END) + 1)")))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ")
    lines = rows.groupBy("session_id", "category", "group").agg(F.min("at").alias("at"), F.first("dir").alias("dir"), F.first("n").alias("n"), F.count("*").alias("k"), names.alias("names"))
    under = F.when(F.col("group") != "", F.concat(F.lit(" under "), "group")).otherwise("")
    head = F.concat("category", F.when(F.col("dir") != "", F.concat(F.lit(" (in "), "dir", F.lit(")"))).otherwise(""), F.lit(": "), "names")
    more = F.concat("category", F.lit(" (+"), F.col("k").cast("string"), F.lit(" more"), under, F.lit("): "), "names")
    rest = F.concat("category", F.lit(" (+"), (F.col("n") - NAMED).cast("string"), F.lit(" more)"))
    text = F.when(F.col("group").isNull(), F.when(F.col("n") > NAMED, F.array(head, rest)).otherwise(F.array(head))).otherwise(F.array(more))
    out = lines.select("session_id", "category", "at", F.posexplode_outer(text).alias("k", "line"))
    nth = F.row_number().over(per.orderBy("k", "at"))
    return out.select("session_id", "category", nth.alias("nth"), "line")


def _listed(rows: DataFrame, name: str, *order: str, line: str = "line") -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(*order, line)))
    return rows.groupBy("session_id").agg(F.transform(ordered, lambda x: x[line]).alias(name))


def sections(blocks: DataFrame) -> DataFrame:
    """session_id and the lines of each section as arrays: goals, files, commits, blockers, preferences (without goals)."""
    files = category_lines(touched_files(blocks))
    files = files.withColumn("c", F.when(F.col("category") == "Modified", 0).otherwise(1))
    made = facts.commits(blocks).groupBy("session_id", "hash", "message").agg(F.min("blk").alias("blk"))
    made = made.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("blk"), F.desc("message")))).where("back <= 8")
    made = made.withColumn("line", F.concat(F.coalesce(F.concat("hash", F.lit(": ")), F.lit("")), "message"))
    per = blocks.select("session_id").distinct().join(facts.goals(blocks), "session_id", "left")
    for more in (_listed(files, "files", "c", "nth"), _listed(made, "commits", "blk"), _listed(facts.blockers(blocks), "blockers", "nth"), _listed(facts.preferences(blocks), "preferences", "nth")):
        per = per.join(more, "session_id", "left")
    none = F.array().cast("array<string>")
    filled = per.select("session_id", *[F.coalesce(c, none).alias(c) for c in TITLES])
    stated = F.transform("goals", lambda g: F.lower(g))
    return filled.withColumn("preferences", F.filter("preferences", lambda p: ~F.array_contains(stated, F.lower(p))))


def summaries(blocks: DataFrame, ranked: bool = True, note: bool = True) -> DataFrame:
    """session_id, summary, brief_lines and the sections: titles with bulleted lines, a rule, the brief, lines wrapped.

    ranked: the brief shows the blocks that `brief.selected` takes; else all, and its last lines. Noise is left out first.
    """
    clean = written(facts.without_noise(blocks))  # read by each section and the brief
    shown = clean.join(brief.selected(clean), ["session_id", "blk"], "left_semi") if ranked else clean
    told = sections(clean).join(brief.capped(brief.lines(shown)), "session_id", "left")
    part = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    top = F.nullif(F.concat_ws("\n\n", *[part(c, t) for c, t in TITLES.items()]), F.lit(""))
    body = T.wrapped(F.nullif(F.concat_ws(RULE, top, F.col("brief")), F.lit("")))
    return told.withColumn("summary", F.concat(body, F.lit(RULE + NOTE if note else ""))).drop("brief")


def without_note(summary: Column) -> Column:
    """Without the note at the end, however it was wrapped, and the rule before it."""
    words = r"\s+".join(w.replace(".", r"\.") for w in NOTE.split())
    return F.regexp_replace(summary, rf"(?:\s*---)?\s*{words}\s*\z", "")


def section_of(summary: Column, title: str) -> Column:
    """The lines of a titled section, read back from the part before the first rule; null without it."""
    top = F.element_at(F.split(summary, RULE), 1)
    others = "|".join(t for t in TITLES.values() if t != title)
    found = F.regexp_extract(top, rf"(?:^|\n)\[{title}\]\n([\s\S]*?)(?=\n\[(?:{others})\]|\z)", 1)
    return F.when(found != "", X.trim_blank(found))


def entry_documents(messages: DataFrame) -> DataFrame:
    """session_id, idx, doc: what a search reads of each message (session_id, seq, message): role, text, and the files of its calls."""
    m, raw = F.col("message"), F.col("raw") if "raw" in messages.columns else None
    args = F.transform(M.parts(m, "toolCall"), lambda p: F.try_variant_get(p, "$.arguments", "variant"))
    files = F.filter(F.transform(args, M.file_path), lambda p: p.isNotNull())
    return messages.select("session_id", F.col("seq").alias("idx"), F.concat_ws(" ", M.rendered_role(m), M.search_document(m, raw=raw), F.array_join(files, " ")).alias("doc"))


def probe_queries(told: DataFrame) -> DataFrame:
    """session_id, label, query: what the first goal, file and blocker of a session (session_id, goals, file, blockers) would be searched by."""
    probes = {"goal": F.try_element_at("goals", F.lit(1)), "file": F.col("file"), "problem": F.try_element_at("blockers", F.lit(1))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), X.query_of(X.trim_blank(F.coalesce(v, F.lit("")))).alias("query")) for k, v in probes.items()]))
    return told.select("session_id", each.alias("p")).select("session_id", "p.*").where("query <> ''")


def reports(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per session: messages, roles, block kinds, sizes before and after, their ratio, sections, and for the first goal, file
    and blocker the query it gives, whether the summary mentions all its terms, and how many entries a search by it finds.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    kinds = blocks.groupBy("session_id").agg(count("user").alias("user_blocks"), count("assistant").alias("assistant_blocks"), count("tool_call").alias("calls"), count("tool_result").alias("results"), F.min_by("path", F.when(F.col("path").isNotNull(), F.col("blk"))).alias("file"))
    use = M.usage(messages).select("session_id", F.col("n").alias("messages"), "users", "assistants", (F.col("input_chars") + F.col("output_chars")).alias("chars_before"))
    # The summary's plan is large: it is cut here, and read by the probes and the report.
    told = written(kinds.join(summaries(blocks), "session_id").withColumn("summary", F.coalesce("summary", F.lit(""))))
    asked = probe_queries(told)
    probes = asked.join(many.hit_counts(entry_documents(messages), asked), ["session_id", "label"]).groupBy("session_id").agg(
        *[F.max(F.when(F.col("label") == k, F.col(c))).alias(f"{k}_{n}") for k in PROBES for c, n in (("query", "query"), ("n_hits", "hits"))]
    )
    rows, after = use.join(told, "session_id").join(probes, "session_id", "left"), F.char_length("summary")
    return rows.select(
        "session_id", "messages", "users", "assistants", "user_blocks", "assistant_blocks", "calls", "results", "chars_before", after.alias("chars_after"),
        F.when(after > 0, F.round(F.col("chars_before") / after, 2)).otherwise(0).alias("ratio"), sum([(F.size(c) > 0).cast("int") for c in TITLES], F.lit(0)).alias("n_sections"),
        F.size("goals").alias("n_goals"), F.size("blockers").alias("n_blockers"), "brief_lines",
        *[c for k in PROBES for c in (F.col(f"{k}_query"), X.holds_terms(F.col("summary"), F.col(f"{k}_query")).alias(f"{k}_mentioned"), F.col(f"{k}_hits"))],
    )
