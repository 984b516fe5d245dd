"""Blocks of sessions: scores, boosts from neighbours, pairs of calls and results, runs, touched files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.brief import only_scaffolding

#: Command and tool patterns.
TEST = r"(?i)(?<![A-Za-z0-9_])(?:bun|npm|pnpm|yarn|node|pytest|cargo|go|mvn|gradle)(?![A-Za-z0-9_])[^\n]*(?:test|spec|check|lint|build|tsc)"
WORKFLOW = r"(?i)(?:^|\s)(?:gh\s+(?:pr|issue)\s+[a-z-]+|git\s+(?:commit|push|merge|rebase|revert|cherry-pick|tag|reset|checkout|branch)(?![A-Za-z0-9_]))"
BASH_PATH = r"(?:^|\s)([A-Za-z0-9_./-]+\.[A-Za-z0-9_-]+)(?:\s|$)"
EDITS = r"(?i)^(edit|write|multiedit|quick_edit|target_edit|apply_patch)$"
READS = r"(?i)^(read|glob|grep|ls|find|semantic_query|semantic_grep|semantic_show)$"


def _session():
    return Window.partitionBy("session_id").orderBy("blk")


def following(kinds: Column) -> Column:
    """The next value of kinds, where it isn't null, after a block: the last one before it from the end on, so a session is read once."""
    return F.last(kinds, True).over(Window.partitionBy("session_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1))


def scores(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """blocks with score and reasons: recency, kind, tool, command and outcome, by fixed points.

    files (session_id, path, activity: modified or read), where the host knows them: calls and commands that name one gain.
    """
    path = F.when(F.col("kind") == "tool_call", F.col("path") if "path" in blocks.columns else None).when(F.col("kind") == "bash", F.regexp_extract("command", BASH_PATH, 1))
    rows, modified, read = blocks, F.lit(False), F.lit(False)
    if files is not None:
        known = files.where("path <> ''").groupBy("session_id", F.col("path").alias("known_path")).agg(F.bool_or(F.col("activity") == "modified").alias("known_modified"), F.bool_or(F.col("activity") == "read").alias("known_read"))
        rows = blocks.withColumn("known_path", path).join(known, ["session_id", "known_path"], "left")
        modified, read = F.col("known_modified"), F.col("known_read")
    n = F.count("*").over(Window.partitionBy("session_id"))
    recency = F.when(n > 1, F.floor(F.col("blk") / (n - 1) * 12 + 0.5)).otherwise(0)
    is_bash, is_call = F.col("kind") == "bash", F.col("kind") == "tool_call"
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    has = F.when(is_bash | (F.lower("name") == "bash"), F.coalesce("command", F.lit(""))).otherwise("")
    trivial = ((is_bash & ~failed) | (is_call & (has != ""))) & only_scaffolding(has)
    named = F.coalesce("name", F.lit(""))
    call = F.when(named.rlike(EDITS), F.struct(F.lit("edit-tool"), F.lit(34))).when(has.rlike(TEST), F.struct(F.lit("test-command"), F.lit(26)))
    call = call.when(named.rlike(READS), F.struct(F.lit("read-tool"), F.lit(6))).otherwise(F.struct(F.lit("tool-call"), F.lit(12)))
    rule = lambda when, name, points: F.when(when, F.struct(F.lit(name).alias("reason"), F.lit(points).alias("points")))
    rules = [
        rule(F.col("kind") == "user", "user-turn", 18), rule(F.col("kind") == "assistant", "assistant-context", 10), rule(F.col("kind") == "custom", "custom-context", 12),
        rule(F.col("kind") == "tool_result", "tool-result-low-value", 1), F.when(is_call, call), rule(is_bash, "bash", 8), rule(is_bash & failed, "nonzero-exit", 24),
        rule(is_bash & has.rlike(TEST), "test-command", 22), rule((is_bash | is_call) & has.rlike(WORKFLOW), "workflow-command", 14),
        rule(trivial, "trivial-bash", -16), rule(modified, "hook-modified-file", 18), rule(read, "hook-read-file", 6),
        rule((F.col("kind") == "tool_result") & (F.char_length("text") > 1000), "long-tool-result", -8),
    ]
    named_rules = [r.cast("struct<reason:string,points:int>") for r in rules]
    hit = F.filter(F.array(*named_rules), lambda r: r.isNotNull())
    total = sum([F.coalesce(r["points"], F.lit(0)) for r in named_rules], recency)
    return rows.select(*[F.col(f"`{c}`") for c in blocks.columns], total.cast("long").alias("score"), F.transform(hit, lambda r: r["reason"]).alias("reasons"))


def _near() -> dict[str, Column]:
    """Of an important block the user block before it, the assistant block before it and the block that follows, which gain from it."""
    important = (F.col("score") >= 34) | F.arrays_overlap("reasons", F.array(F.lit("edit-tool"), F.lit("test-command"), F.lit("nonzero-exit")))
    back = lambda kind, far: F.last(F.when(F.col("kind") == kind, F.col("blk")), True).over(_session().rowsBetween(-far, -1))
    ahead = F.first(F.when(F.col("kind").isin("assistant", "bash"), F.col("blk")), True).over(_session().rowsBetween(1, 4))
    return {"important": important, "u": back("user", 8), "a": back("assistant", 4), "n": ahead}


def adjacency(ranked: DataFrame) -> DataFrame:
    """session_id, blk, boost: what blocks gain from important ones near them; each important one counts."""
    near = ranked.select("session_id", *[c.alias(k) for k, c in _near().items()]).where("important")
    gains = near.select("session_id", F.explode(F.array(*[F.struct(F.col(c).alias("blk"), F.lit(p).alias("p")) for c, p in (("u", 10), ("a", 7), ("n", 5))])).alias("g"))
    return gains.where("g.blk is not null").groupBy("session_id", F.col("g.blk").alias("blk")).agg(F.sum("g.p").alias("boost"))


def closing(blocks: DataFrame, least: int = 120) -> DataFrame:
    """session_id, blk of assistant blocks of at least so many characters that a user block, or nothing, follows."""
    return blocks.withColumn("closes", _closes(least)).where("closes").select("session_id", "blk")


def _closes(least: int = 120) -> Column:
    long_enough = F.char_length(F.regexp_replace("text", r"^\s+|\s+\z", "")) >= least
    next_kind = following(F.when(F.col("kind") != "tool_result", F.col("kind")))
    return (F.col("kind") == "assistant") & long_enough & F.coalesce(next_kind == "user", F.lit(True))


def ranked(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """scores with both boosts (adjacency, closing), read off the blocks around each in one order of a session, without a join."""
    base = scores(blocks, files)
    near = {k: c.alias(f"_{k}") for k, c in _near().items()}
    rows = base.select("*", *near.values())
    # A user block gains from important ones up to 8 after it that have none nearer, and so on.
    gain = lambda c, points, places: [F.when(F.lead(F.when(F.col("_important"), F.col(c)), k).over(_session()) == F.col("blk"), points).otherwise(0) for k in places]
    boost = sum(gain("_u", 10, range(1, 9)) + gain("_a", 7, range(1, 5)) + gain("_n", 5, range(-4, 0)), F.lit(0))
    return rows.select(*[F.col(f"`{c}`") if c != "score" else (F.col("score") + boost + F.when(_closes(), 14).otherwise(0)).alias("score") for c in base.columns])


def call_results(blocks: DataFrame, result: Column) -> DataFrame:
    """session_id, blk, result_blk: for each call the first later block for which `result` holds, before the next call or user."""
    stop = following(F.when(F.col("kind").isin("tool_call", "user"), F.col("blk")))
    found = following(F.when(result, F.col("blk")))
    rows = blocks.select("session_id", "blk", "kind", stop.alias("stop"), found.alias("result_blk"))
    return rows.where("kind = 'tool_call' and result_blk is not null and (stop is null or result_blk < stop)").select("session_id", "blk", "result_blk")


def sections(blocks: DataFrame) -> DataFrame:
    """Runs of blocks under one header: session_id, section, header, first_blk, n_blocks."""
    header = F.when(F.col("kind").isin("user", "bash"), "[user]").when(F.col("kind").isin("assistant", "tool_call"), "[assistant]").when(F.col("kind") == "custom", "[custom]")
    lines = blocks.select("session_id", "blk", header.alias("header")).where("header is not null")
    new = F.when(F.lag("header").over(_session()) == F.col("header"), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("section", F.sum("new").over(_session()))
    return runs.groupBy("session_id", "section").agg(F.first("header").alias("header"), F.min("blk").alias("first_blk"), F.count("*").alias("n_blocks"))


def repeats(blocks: DataFrame) -> DataFrame:
    """Runs of calls with the same name and directory: session_id, first_blk, name, dir, times."""
    calls = blocks.where("kind = 'tool_call'").withColumn("dir", F.regexp_extract("path", "^(.*)/", 1))
    changed = F.coalesce((F.lag("name").over(_session()) != F.col("name")) | (F.lag("dir").over(_session()) != F.col("dir")) | (F.lag("blk").over(_session()) != F.col("blk") - 1), F.lit(True))
    runs = calls.withColumn("new", changed.cast("int")).withColumn("run", F.sum("new").over(_session()))
    return runs.groupBy("session_id", "run").agg(F.min("blk").alias("first_blk"), F.first("name").alias("name"), F.first("dir").alias("dir"), F.count("*").alias("times")).drop("run")


def last_calls(blocks: DataFrame, most: int = 8) -> DataFrame:
    """The last calls of each turn (from a user block on): session_id, turn, blk, and how many the turn lost."""
    turn = F.sum((F.col("kind") == "user").cast("int")).over(_session())
    calls = blocks.withColumn("turn", turn).where("kind = 'tool_call'")
    per = Window.partitionBy("session_id", "turn")
    rows = calls.withColumn("n", F.count("*").over(per)).withColumn("back", F.row_number().over(per.orderBy(F.desc("blk"))))
    return rows.where(F.col("back") <= most).select("session_id", "turn", "blk", F.greatest(F.lit(0), F.col("n") - most).alias("omitted"))


def touched(blocks: DataFrame) -> DataFrame:
    """session_id, path, first_blk, entries (blk:tool, in order)."""
    rows = blocks.where("path is not null").groupBy("session_id", "path")
    entries = F.array_sort(F.collect_list(F.struct("blk", "name")))
    return rows.agg(F.min("blk").alias("first_blk"), F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["blk"].cast("string"), e["name"])), ",").alias("entries"))


def file_activity(blocks: DataFrame) -> DataFrame:
    """session_id, path, activity: modified where a call wrote the file, else read."""
    wrote = F.lower("name").isin("edit", "write", "edit_file", "write_file", "multiedit", "quick_edit", "target_edit", "apply_patch")
    rows = blocks.where("kind = 'tool_call' and path is not null").groupBy("session_id", "path").agg(F.max(wrote.cast("int")).alias("w"))
    return rows.select("session_id", "path", F.when(F.col("w") == 1, "modified").otherwise("read").alias("activity"))


def common_directory(paths: DataFrame) -> DataFrame:
    """session_id, dir: the longest directory that all absolute paths share, at least two deep: that of the least and the greatest path."""
    ends = paths.where(F.col("path").startswith("/")).groupBy("session_id").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count("*").alias("n"), F.min(F.size(F.split("path", "/"))).alias("depth"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda i: F.element_at(a, i) == F.element_at(b, i))
    n = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.size(same))
    shared = F.when(F.array_position(same, F.lit(False)) == 0, F.size(same)).otherwise(n).cast("int")
    return ends.where("n >= 2").select("session_id", F.when(shared >= 2, F.concat(F.array_join(F.slice(a, F.lit(1), shared), "/"), F.lit("/"))).otherwise("").alias("dir"))
