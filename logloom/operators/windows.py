"""Live windows, cut points, token budgets and summary chains of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import script_tokens

TAIL_LEAST, TAIL_MOST, OVERSIZED = 5_000, 25_000, 2.5


def _by_session():
    return Window.partitionBy("session_id")


def live_entries(entries: DataFrame) -> DataFrame:
    """Entries of the live window: after the last reset if it is newer than the last compaction; else from the entry that
    compaction names, if it is named once and before it; else right after it. Markers go.

    Columns: session_id, seq, entry_id, type, first_kept.
    """
    last = lambda kind: F.max(F.when(F.col("type") == kind, F.col("seq"))).over(_by_session())
    rows = entries.withColumn("compacted", last("compaction")).withColumn("reset", last("reset_boundary"))
    kept = F.max(F.when(F.col("seq") == F.col("compacted"), F.col("first_kept"))).over(_by_session())
    rows = rows.withColumn("kept", kept)
    is_anchor = (F.col("entry_id") == F.col("kept")) & (F.col("kept") != "")
    rows = rows.withColumn("n_anchor", F.count_if(is_anchor).over(_by_session())).withColumn("anchor", F.min(F.when(is_anchor, F.col("seq"))).over(_by_session()))
    start = (
        F.when(F.col("reset") > F.coalesce("compacted", F.lit(-1)), F.col("reset") + 1)
        .when((F.col("n_anchor") == 1) & (F.col("anchor") < F.col("compacted")), F.col("anchor"))
        .otherwise(F.coalesce(F.col("compacted") + 1, F.lit(0)))
    )
    return rows.where((F.col("seq") >= start) & F.col("type").isin("message", "custom_message", "branch_summary")).select("session_id", "seq", "entry_id", "type")


def global_index(entries: DataFrame) -> DataFrame:
    """session_id, entry_id, idx (place among messages) of ids that occur once."""
    messages = entries.where("type = 'message'").withColumn("idx", (F.row_number().over(_by_session().orderBy("seq")) - 1).cast("long"))
    once = F.count("*").over(Window.partitionBy("session_id", "entry_id"))
    return messages.withColumn("n", once).where("n = 1 and entry_id is not null").select("session_id", "entry_id", "idx")


def with_places(messages: DataFrame) -> DataFrame:
    """messages (session_id, seq, role, tokens) with i (place), n, suffix (tokens from here on), back (user turns from here on)."""
    down = _by_session().orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    is_user = (F.col("role") == "user").cast("int")
    return messages.select(
        "session_id", "seq", "role", "tokens", (F.row_number().over(_by_session().orderBy("seq")) - 1).alias("i"), F.count("*").over(_by_session()).alias("n"),
        F.sum("tokens").over(down).alias("suffix"), F.sum(is_user).over(down).alias("back"),
    )


def cuts(messages: DataFrame, keep: int = 1, explicit: bool = False) -> DataFrame:
    """session_id, outcome (cut, compact_all, too_few), cut (messages before it are summarized), kept_turns."""
    is_turn = F.col("role") == "user"
    per = with_places(messages).groupBy("session_id").agg(
        F.max("n").alias("n"), F.count_if(is_turn).alias("users"), F.min(F.when(is_turn, F.col("i"))).alias("first_user"), F.min(F.when(is_turn & (F.col("back") == keep), F.col("i"))).alias("at")
    )
    usable = F.coalesce(F.col("at") > 0, F.lit(False)) & F.lit(keep > 0)
    whole = F.lit(explicit and keep > 0) & (F.col("users") > 0)
    outcome = F.when(F.col("n") <= 2, "too_few").when(usable | whole, "cut").otherwise("compact_all")
    at = F.when(F.col("n") <= 2, F.lit(None)).when(usable, F.col("at")).when(whole, F.col("first_user")).otherwise(F.col("n"))
    kept = F.when(F.col("n") <= 2, F.lit(None)).when(usable, F.lit(keep)).when(whole, F.col("users")).otherwise(0)
    return per.select("session_id", outcome.alias("outcome"), at.cast("long").alias("cut"), kept.cast("long").alias("kept_turns"))


def smart_keep(messages: DataFrame, least: int = TAIL_LEAST, most: int = TAIL_MOST) -> DataFrame:
    """session_id, keep: 1, or where that tail is small the most user turns whose tail is small enough and leaves a prefix."""
    users = with_places(messages).where("role = 'user' and n > 2 and i > 0")
    per = users.groupBy("session_id").agg(F.max(F.when(F.col("suffix") <= most, F.col("back"))).alias("grown"), F.max(F.when((F.col("back") == 1) & (F.col("suffix") <= least), 1)).alias("small"))
    all_sessions = messages.select("session_id").distinct()
    return all_sessions.join(per, "session_id", "left").select("session_id", F.when(F.col("small") == 1, F.coalesce("grown", F.lit(1))).otherwise(1).cast("long").alias("keep"))


def budget_cuts(messages: DataFrame, most: int = TAIL_MOST) -> DataFrame:
    """session_id, cut: the first place, at or after the last one whose tail reaches `most` tokens, that is no tool result; -1 without one."""
    rows = with_places(messages).withColumn("crossed", F.max(F.when(F.col("suffix") >= most, F.col("i"))).over(_by_session()))
    fit = F.col("crossed").isNotNull() & (F.col("i") >= F.greatest(F.col("crossed"), F.lit(1))) & (F.col("role") != "toolResult")
    return rows.groupBy("session_id").agg(F.coalesce(F.min(F.when(fit, F.col("i"))), F.lit(-1)).cast("long").alias("cut"))


def retained_outputs(outputs: DataFrame, limit: int, marker: int = 15) -> DataFrame:
    """outputs (session_id, seq, tokens), all of them consumed, with kept: newest first while their sum fits; after the first that doesn't, only those no dearer than a marker."""
    newest = _by_session().orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = outputs.withColumn("spent", F.sum("tokens").over(newest)).withColumn("rn", F.row_number().over(_by_session().orderBy(F.desc("seq"))))
    rows = rows.withColumn("broken", F.min(F.when((F.col("tokens") > marker) & (F.col("spent") > limit), F.col("rn"))).over(_by_session()))
    kept = F.col("broken").isNull() | (F.col("rn") < F.col("broken")) | (F.col("tokens") <= marker)
    return rows.select("session_id", "seq", "tokens", kept.alias("kept"))


def output_projection(messages: DataFrame, limit: int, marker: Column | int = 15) -> DataFrame:
    """messages (session_id, seq, id, output, done, tokens) to session_id, seq, tokens, kept, pending, n_pending of outputs.

    Outputs after the session's last assistant that is done are pending: shown and free of charge, as are all without such
    an assistant. Of the others those with an id that the session holds once share the limit as in retained_outputs;
    outputs whose id is missing or repeated neither spend nor go, and a limit of 0 omits nothing. n_pending counts a
    session's pending outputs.
    """
    by_id = Window.partitionBy("session_id", "id")
    rows = messages.withColumn("once", (F.coalesce("id", F.lit("")) != "") & (F.count("*").over(by_id) == 1))
    rows = rows.withColumn("boundary", F.max(F.when(F.col("done"), F.col("seq"))).over(_by_session())).where("output")
    rows = rows.withColumn("pending", F.coalesce(F.col("seq") > F.col("boundary"), F.lit(True))).withColumn("marker", marker if isinstance(marker, Column) else F.lit(marker))
    rows = rows.withColumn("charged", ~F.col("pending") & F.col("once") & F.lit(limit > 0)).withColumn("cost", F.when(F.col("charged"), F.col("tokens")).otherwise(0))
    newest = _by_session().orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("spent", F.sum("cost").over(newest)).withColumn("dear", F.col("charged") & (F.col("tokens") > F.col("marker")))
    rows = rows.withColumn("broken", F.max(F.when(F.col("dear") & (F.col("spent") > limit), F.col("seq"))).over(_by_session()))
    kept = ~F.col("dear") | F.col("broken").isNull() | (F.col("seq") > F.col("broken"))
    return rows.select("session_id", "seq", "tokens", kept.alias("kept"), "pending", F.count_if("pending").over(_by_session()).alias("n_pending"))


def growth_trips(prefix: Column, fresh: Column) -> Column:
    """Whether a summary grew more than 512 characters or 25 % of what it replaces, or 4096 characters."""
    growth = fresh - prefix
    return (growth > F.greatest(F.lit(512), F.floor(prefix * 0.25 + 0.5))) | (growth > 4096)


def append_mode(window: Column, reserve: Column, chain: Column, rebased: Column, full: Column) -> Column:
    """append or rebase: by pressure of the chain and the window, and by what a rebase saves."""
    known = window > 0
    pressure = chain >= F.when(known, F.floor(window / 8)).otherwise(34_000)
    saving = F.when(known, F.greatest(F.lit(1), F.least(F.lit(24_000), F.floor(window * 24_000 / 272_000)))).otherwise(24_000)
    tight = F.coalesce(known & (full > F.greatest(F.lit(0), window - reserve)), F.lit(False))
    smaller = F.coalesce(rebased < chain, F.lit(False))
    worth = F.coalesce(pressure & (F.greatest(F.lit(0), full - rebased) >= saving), F.lit(False))
    return F.when(smaller & ((tight & rebased.isNotNull()) | (~tight & worth)), "rebase").otherwise("append")


def chains(segments: DataFrame) -> DataFrame:
    """segments (session_id, sequence, first_covered, first_kept, summary): session_id, valid, n, tokens.

    Valid: numbered 1..n without gaps or repeats, and each begins where the one before it stopped keeping, if that names a place.
    """
    order = _by_session().orderBy("sequence")
    before, kept = F.lag("sequence").over(order), F.lag("first_kept").over(order)
    first = before.isNull() & (F.col("sequence") == 1)
    joined = (F.col("sequence") == before + 1) & ((kept == "") | (kept == F.col("first_covered")))
    rows = segments.select("session_id", F.coalesce(first | joined, F.lit(False)).alias("ok"), script_tokens(F.col("summary")).alias("t"))
    return rows.groupBy("session_id").agg(F.bool_and("ok").alias("valid"), F.count("*").alias("n"), F.sum("t").alias("tokens"))


def merged_lines(previous: Column, fresh: Column, most: int, pinned: bool = False) -> Column:
    """Both lists without repeats, the newest `most`; pinned: the first one and the newest of the rest."""
    lines = F.array_distinct(F.concat(previous, fresh))
    newest = F.slice(lines, F.greatest(F.size(lines) - most + 1, F.lit(1)), F.lit(most))
    if not pinned:
        return newest
    rest = F.slice(lines, F.size(lines) - most + 2, F.lit(most - 1))
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, 1), rest))


def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The newest rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def tail_budget(messages: DataFrame, keep: int = 1, explicit: bool = False, most: int = TAIL_MOST, factor: float = OVERSIZED) -> DataFrame:
    """cuts with `budget_cut`: where no user turn could be kept (and keep is not 0 by request) the cut moves back to the
    budget's place (no_anchor); where the kept tail exceeds `factor` times the budget it moves on to it (oversized_tail).
    """
    first = cuts(messages, keep, explicit)
    placed = with_places(messages)
    at_budget = budget_cuts(messages, most).withColumnRenamed("cut", "budget")
    tails = placed.select("session_id", F.col("i").alias("cut"), F.col("suffix").alias("tail"))
    rows = first.join(at_budget, "session_id").join(tails, ["session_id", "cut"], "left")
    no_anchor = (F.col("outcome") == "compact_all") & F.lit(keep > 0) & (F.col("budget") >= 0)
    oversized = (F.col("outcome") == "cut") & (F.coalesce("tail", F.lit(0)) > most * factor) & (F.col("budget") > F.col("cut"))
    rows = rows.withColumn("budget_cut", F.when(no_anchor, "no_anchor").when(oversized, "oversized_tail"))
    moved = rows.withColumn("cut", F.when(F.col("budget_cut").isNotNull(), F.col("budget")).otherwise(F.col("cut"))).withColumn("outcome", F.when(F.col("budget_cut").isNotNull(), "cut").otherwise(F.col("outcome")))
    turns = placed.select("session_id", F.col("i").alias("cut"), F.col("back").alias("turns"))
    kept = F.when(F.col("budget_cut").isNotNull(), F.coalesce("turns", F.lit(0))).otherwise(F.col("kept_turns"))
    return moved.join(turns, ["session_id", "cut"], "left").select("session_id", "outcome", "cut", kept.cast("long").alias("kept_turns"), "budget_cut")


def full_context_tokens(entries: DataFrame, model: str | None = None) -> DataFrame:
    """entries (session_id, seq, type, role, stop_reason, model, context_tokens, tokens) to session_id, tokens: what the
    newest usable assistant after the last boundary states for its context, and the estimates of all messages after it.
    Sessions without such an assistant have none.
    """
    boundary = F.max(F.when(F.col("type").isin("compaction", "reset_boundary"), F.col("seq"))).over(_by_session())
    usable = (F.col("type") == "message") & (F.col("role") == "assistant") & ~F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False)) & (F.col("context_tokens") > 0)
    usable = usable & F.coalesce(F.col("seq") > F.col("boundary"), F.lit(True)) & (F.coalesce(F.col("model") == model, F.lit(True)) if model else F.lit(True))
    rows = entries.withColumn("boundary", boundary)
    rows = rows.withColumn("anchor", F.max(F.when(usable, F.struct("seq", "context_tokens"))).over(_by_session())).where("anchor is not null")
    later = F.when((F.col("type") == "message") & (F.col("seq") > F.col("anchor.seq")), F.col("tokens")).otherwise(0)
    return rows.groupBy("session_id").agg((F.first("anchor.context_tokens") + F.sum(later)).cast("long").alias("tokens"))


def savings(messages: DataFrame, cut: DataFrame, summary_tokens: Column) -> DataFrame:
    """session_id, before, prefix_chars, kept_tokens, after, saved, percent: messages also have chars; cut has session_id, cut."""
    rows = messages.withColumn("i", F.row_number().over(_by_session().orderBy("seq")) - 1).join(cut.select("session_id", "cut"), "session_id").where("cut is not null")
    kept = F.col("i") >= F.col("cut")
    per = rows.groupBy("session_id").agg(F.sum("tokens").alias("before"), F.sum(F.when(kept, 0).otherwise(F.col("chars"))).alias("prefix_chars"), F.sum(F.when(kept, F.col("tokens")).otherwise(0)).alias("kept_tokens"))
    per = per.withColumn("after", summary_tokens + F.col("kept_tokens")).withColumn("saved", F.when(F.col("before") > 0, F.greatest(F.lit(0), F.col("before") - F.col("after"))).otherwise(0))
    return per.withColumn("percent", F.when(F.col("saved") > 0, F.floor(F.col("saved") * 100 / F.col("before") + 0.5)).otherwise(0))


def resolved_index(loaded: DataFrame, scanned: DataFrame) -> DataFrame:
    """global_index of the entries at hand, and of sessions without any of the scanned files."""
    missing = scanned.join(loaded.select("session_id").distinct(), "session_id", "left_anti")
    return global_index(loaded).unionByName(global_index(missing))


def with_global_index(selected: DataFrame, index: DataFrame) -> DataFrame:
    """selected (session_id, entry_id) with idx, null for ids that are missing or not unique."""
    return selected.join(index, ["session_id", "entry_id"], "left")


def scoped(entries: DataFrame, branch: DataFrame) -> DataFrame:
    """session_id, entry_id, idx of the entries that a search of the active branch reads: entries (session_id, seq, entry_id, type),
    branch (session_id, entry_id).

    A session's branch names its entries; where it has none all of the session's ids count; a branch whose entries have no
    ids names nothing. The index is an entry's place among all messages, made before anything is filtered.
    """
    named = branch.groupBy("session_id").agg(F.lit(True).alias("branched"))
    ids = branch.where("entry_id <> ''").select("session_id", "entry_id", F.lit(True).alias("inside")).distinct()
    rows = global_index(entries).join(named, "session_id", "left").join(ids, ["session_id", "entry_id"], "left")
    return rows.where("branched is null or inside").select("session_id", "entry_id", "idx")


def active_chain(summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """session_id, seq, sequence of the segments of each session's chain, where the chain is whole.

    summaries: session_id, seq, append (its details are a valid segment that the entry repeats), chain_start, sequence,
    first_covered, last_covered, first_kept. entries: session_id, seq, entry_id. The chain begins at the newest start and
    ends at the newest summary; all between are segments, numbered from 1, each covers entries that the session holds once
    and in order, keeps what lies after them or nothing, and begins where the one before it stopped keeping.
    """
    start = F.max(F.when(F.col("append") & F.col("chain_start"), F.col("seq"))).over(_by_session())
    rows = summaries.withColumn("start", start).where(F.col("seq") >= F.col("start"))
    once = entries.where("entry_id is not null").groupBy("session_id", "entry_id").agg(F.count("*").alias("n"), F.min("seq").alias("place")).where("n = 1")
    for end in ("first_covered", "last_covered", "first_kept"):
        rows = rows.join(once.select("session_id", F.col("entry_id").alias(end), F.col("place").alias(f"at_{end}")), ["session_id", end], "left")
    covered = (F.col("at_first_covered") <= F.col("at_last_covered")) & ((F.col("first_kept") == "") | (F.col("at_first_kept") > F.col("at_last_covered")))
    order = _by_session().orderBy("seq")
    kept = F.lag("first_kept").over(order)
    joined = kept.isNull() | (kept == "") | (kept == F.col("first_covered"))
    ok = F.coalesce(F.col("append") & covered & joined & (F.col("sequence") == F.row_number().over(order)), F.lit(False))
    checked = rows.withColumn("ok", ok).withColumn("whole", F.bool_and("ok").over(_by_session()))
    return checked.where("whole").select("session_id", "seq", "sequence")
