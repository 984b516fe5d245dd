"""Conversation structure repair: the cheapest edits that make each conversation's roles `(s?(ua)+)?`.

Spark deals turns by conversation and sorts them; a window over the same shuffle finds repeats and neighbours. Each task
streams its conversations in batches, and a recursive DuckDB query advances all conversations of a batch by one turn a
recursion: it keeps, for each of the four states of the grammar, the least cost and with it the ASCII-least audit.
States, by the roles put out so far: 0 none, 1 system alone, 2 ends with user, 3 ends with assistant; 0 and 3 may end.

A key of the query is cost (12 digits), rank and audit, so the least text is the least cost and then the least audit.
Rank orders the audits with which a segment of at most SEGMENT turns began: a longer conversation is carried from segment
to segment by four audits and four running hashes, so a task holds one batch of texts, however long a conversation is. (No
audit of a state before its trailing inserts starts another one: both hold one edit per turn and end with one.) A
conversation is one task's stream, since its result is one hash over its whole text in order.

Edits: Keep 0, Rerole to the role that the grammar asks for (user or assistant) 3, Delete 4, Insert an empty turn 3; a truncated
turn that stays adds 3; blank and repeated turns must be deleted. Defaults are the costs of COSTS.

Defined cases: a null role, text, turn or conv_id counts as one space in texts and in the key of the damage; null turns come first; rows
of one turn follow by role, then text; a null conv_id is a conversation of its own; repeated rows are duplicates; roles
count by their first character, any but s, u and a must be reroled or deleted; a conversation that lost all rows has
zeros, an empty audit and the hash of the empty text; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, table

SEGMENT = 256
#: keep, rerole, delete, insert, a truncated turn that stays
COSTS = (0, 3, 4, 3, 3)
FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped of turns after damage by a hash of conversation and turn; dropped rows stay, marked."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    own = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _initial(role: Column | str) -> Column:
    return F.substring(role, 1, 1)


def faults(turns: DataFrame) -> DataFrame:
    """turns in order within each conversation, with fault (blank, duplicate, truncated or null), illegal and fresh (a turn number not seen before)."""
    if "dropped" not in turns.columns:
        turns = turns.withColumn("dropped", F.lit(False))
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    dealt = own.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "role", "text")).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    same = Window.partitionBy("conv_id", "dropped", "h1", "h2").orderBy(*order)
    conv = Window.partitionBy("conv_id", "dropped").orderBy(*order, "nth")
    seen = dealt.withColumn("nth", F.row_number().over(same))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(F.btrim("text", F.lit(BLANKS)) == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    before, last = F.lag(_initial("role")).over(conv), F.lag("turn").over(conv)
    return seen.select(
        "conv_id", "turn", "role", "text", "dropped", F.row_number().over(conv).alias("position"), fault.alias("fault"),
        F.coalesce(~F.concat(before, _initial("role")).isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last)).alias("fresh"),
    )


def advance_sql(costs: tuple[int, ...] = COSTS) -> str:
    """Over `entries` (conv, n0..n3) and `turns` (conv, idx from 1, kind, dead, cut): the keys after the last turn of each conversation."""
    keep, rerole, delete, insert, cut = costs
    plus = lambda k, c, e: f"printf('%012d', CAST(substr({k}, 1, 12) AS BIGINT) + {c}) || substr({k}, 13) || '{e}'"
    one, other = f"least({', '.join(plus(k, insert, 'I') for k in ('n0', 'n1', 'n3'))})", plus("n2", insert, "I")
    # What may stand before a turn: the keys, and those with one or two inserts.
    closed = f"""SELECT conv, idx, n0 AS c0, n1 AS c1, least(n2, i2, {plus('i3', insert, 'I')}) AS c2, least(n3, i3, {plus('i2', insert, 'I')}) AS c3
                 FROM (SELECT *, {one} AS i2, {other} AS i3 FROM d)"""
    stays = f"CASE WHEN t.cut THEN {cut} ELSE 0 END"
    to2, to3 = "least(c0, c1, c3)", "c2"
    step = lambda k, kind, frm: f"least({plus(k, delete, 'D')}, CASE WHEN NOT t.dead AND t.kind = '{kind}' THEN {plus(frm, f'{keep} + {stays}', 'K')} END"
    grown = lambda k, kind, frm: step(k, kind, frm) + f", CASE WHEN NOT t.dead THEN {plus(frm, f'{rerole} + {stays}', 'R')} END)"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv, 0 AS idx, n0, n1, n2, n3 FROM entries
  UNION ALL
  SELECT c.conv, t.idx, {plus('c0', delete, 'D')}, {step('c1', 's', 'c0')}), {grown('c2', 'u', to2)}, {grown('c3', 'a', to3)}
  FROM ({closed}) c JOIN turns t ON t.conv = c.conv AND t.idx = c.idx + 1)
SELECT conv, n0, n1, n2, n3 FROM d QUALIFY idx = max(idx) OVER (PARTITION BY conv)"""


class _Conversation:
    """What is carried of one conversation: by state (cost, audit, hash, turns put out), and its sums."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.states = {0: (0, "", hashlib.sha256(), [])}
        self.least = self.most = None
        self.fresh = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def count(self, rows: list[dict]) -> None:
        for r in rows:
            t = r["turn"]
            if t is not None:
                self.least, self.most = min(t, self.least if self.least is not None else t), max(t, self.most if self.most is not None else t)
            self.fresh += r["fresh"]
            self.illegal += r["illegal"]
            if r["fault"]:
                setattr(self, r["fault"], getattr(self, r["fault"]) + 1)

    def entries(self) -> list[str | None]:
        """A key for each state, and the order of the audits in self.ranked."""
        self.ranked = sorted(self.states, key=lambda s: self.states[s][1])
        return [f"{self.states[s][0]:012d}{self.ranked.index(s)}" if s in self.states else None for s in range(4)]

    def moved(self, keys: list[str | None], rows: list[dict]) -> None:
        """From the segment's keys: what it adds to each state is told later, by settle()."""
        self.after = {s: (int(k[:12]), self.ranked[int(k[12])], k[13:]) for s, k in enumerate(keys) if k is not None}
        self.rows = rows

    def settle(self, only: tuple[int, int, str] | None = None) -> None:
        """Audits and hashes through the segment, for all states or for the one (cost, state before, edits)."""
        made = {}
        for s, (cost, came, edits) in ({0: only} if only else self.after).items():
            _, audit, digest, out = self.states[came]
            made[s] = (cost, audit + edits, *_put_out(digest.copy(), list(out), edits, self.rows))
        self.states, self.rows = made, []

    def end(self, insert: int = COSTS[3]) -> tuple:
        """The cheapest whole: inserts at the end, then the state's audit."""
        if not getattr(self, "rows", None):
            self.after, self.rows = {s: (x[0], s, "") for s, x in self.states.items()}, []
        tails = [(s, e) for s, e in ((0, ""), (3, ""), (2, "I"), (1, "II")) if s in self.after]
        whole = {(self.after[s][0] + insert * len(e), self.states[self.after[s][1]][1] + self.after[s][2] + e): (self.after[s][1], self.after[s][2] + e) for s, e in tails}
        best = min(whole)
        self.settle((best[0], *whole[best]))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.fresh
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best[0], best[1], self.states[0][2].hexdigest())


def _put_out(digest, out: list[str], edits: str, rows: list[dict]) -> tuple:
    """The hash and the last role's initial (or none) after these edits of rows."""
    at = 0
    for e in edits:
        row = None
        if e != "I":
            row, at = rows[at], at + 1
        if e == "D":
            continue
        asked = "assistant" if out and out[-1] == "u" else "user"
        role = row["role"] if e == "K" else asked
        digest.update(("\n" if out else "").encode() + role.encode() + b":" + (row["text"] if row else "").encode())
        out = [role[:1]]
    return digest, out


def _advance(db, group: list[tuple[_Conversation, list[dict]]]) -> None:
    """All conversations of the group by at most SEGMENT turns each."""
    flat = [(i, k + 1, r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for i, (_, rows) in enumerate(group) for k, r in enumerate(rows)]
    turns = pa.table(dict(zip(("conv", "idx", "kind", "dead", "cut"), map(list, zip(*flat, strict=True)), strict=True)))
    keys = [c.entries() for c, _ in group]
    entries = pa.table({"conv": list(range(len(group)))} | {f"n{s}": pa.array([k[s] for k in keys], pa.string()) for s in range(4)})
    db.register("turns", turns)
    db.register("entries", entries)
    for i, *found in db.execute(advance_sql()).fetchall():
        group[i][0].moved(found, group[i][1])


def _stream(schema: pa.Schema):
    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        opened: _Conversation | None = None
        for batch in batches:
            runs: list[tuple[_Conversation, list[dict]]] = []
            for r in batch.to_pylist():
                if not runs and opened is not None and opened.conv_id == r["conv_id"]:
                    runs.append((opened, []))
                elif not runs or runs[-1][0].conv_id != r["conv_id"]:
                    runs.append((_Conversation(r["conv_id"]), []))
                if not r["dropped"]:
                    runs[-1][1].append(r)
            done = [opened.end()] if opened is not None and runs and runs[0][0] is not opened else []
            for at in range(0, max((len(rows) for _, rows in runs), default=0), SEGMENT):
                group = [(c, rows[at : at + SEGMENT]) for c, rows in runs if len(rows) > at]
                for c, rows in group:
                    if at:
                        c.settle()
                    c.count(rows)
                _advance(db, group)
            for c, _ in runs[:-1]:
                done.append(c.end())
            if runs:
                opened = runs[-1][0]
                if getattr(opened, "rows", None):
                    opened.settle()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if opened is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(opened.end(), schema, strict=True)], schema=schema)

    return repaired


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id and the columns of FIGURES for every conversation of turns (conv_id, turn, role, text, perhaps dropped)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = turns.schema["conv_id"].dataType.simpleString()
    found = faults(turns).select("conv_id", "turn", "role", F.when(~F.col("dropped"), F.col("text")).alias("text"), "dropped", "fault", "illegal", "fresh")
    wanted = f"conv_id {kind}, {FIGURES}"
    return found.mapInArrow(_stream(to_arrow_schema(turns.sparkSession.createDataFrame([], wanted).schema)), wanted)


def repaired_turns(turns: DataFrame, fixes: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (from 1), edit, turn, role, text; fixes is repairs(turns).

    Ids are not null here. A turn put out at an odd place is the user's unless a system turn stands first.
    """
    edits = fixes.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    by = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = edits.select("conv_id", "edit", F.sum(F.expr("int(edit <> 'I')")).over(by).alias("position"), F.sum(F.expr("int(edit <> 'D')")).over(by).alias("place"))
    placed = placed.where("edit <> 'D'").withColumn("position", F.when(F.col("edit") != "I", F.col("position")))
    live = faults(turns).where(~F.col("dropped")).select("conv_id", "position", "turn", "role", "text")
    joined = placed.join(live, ["conv_id", "position"], "left")
    first = Window.partitionBy("conv_id")
    led = F.max(F.expr("int(place = 1 and edit = 'K' and substring(role, 1, 1) = 's')")).over(first)
    asked = F.when((F.col("place") - led) % 2 == 1, "user").otherwise("assistant")
    return joined.select("conv_id", "place", "edit", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(asked).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte over a table of 256 made by the rule of its polynomial."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295::BIGINT)"


OP12_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS v
                                          FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, tab),
w AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) AS nth, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY idx) AS before FROM p),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
      count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
-- One row for each partial repair: state, turns used, cost, edits, text; the cheapest of each (turn, state) goes on.
e AS (SELECT conv_id, 0::BIGINT AS idx, 0 AS s, 0 AS cost, '' AS audit, [] :: VARCHAR[] AS out FROM g
  UNION ALL
  SELECT conv_id, idx, s, cost, audit, out FROM (
    SELECT DISTINCT ON (conv_id, s) * FROM (
      SELECT c.conv_id, f.idx, x.s, c.cost + x.cost AS cost, c.audit || x.edit AS audit, CASE WHEN x.edit = 'D' THEN c.out ELSE list_append(c.out, x.role || ':' || f.text) END AS out
      FROM (SELECT conv_id, idx, s, cost, audit, out FROM e
            UNION ALL SELECT conv_id, idx, CASE WHEN s = 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', list_append(out, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) FROM e
            UNION ALL SELECT conv_id, idx, CASE WHEN s = 2 THEN 2 ELSE 3 END, cost + 6, audit || 'II', out || CASE WHEN s = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END FROM e) c
      JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.idx = c.idx + 1,
      LATERAL (SELECT c.s AS s, 4 AS cost, 'D' AS edit, '' AS role
               UNION ALL SELECT CASE f.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'K', f.role
                 WHERE f.fault NOT IN ('b', 'd') AND ((f.role[1] = 's' AND c.s = 0) OR (f.role[1] = 'u' AND c.s <> 2) OR (f.role[1] = 'a' AND c.s = 2))
               UNION ALL SELECT CASE WHEN c.s = 2 THEN 3 ELSE 2 END, CASE f.fault WHEN 't' THEN 6 ELSE 3 END, 'R', CASE WHEN c.s = 2 THEN 'assistant' ELSE 'user' END WHERE f.fault NOT IN ('b', 'd')) x)
    ORDER BY conv_id, s, cost, audit)),
z AS (SELECT e.conv_id, cost + CASE s WHEN 2 THEN 3 WHEN 1 THEN 6 ELSE 0 END AS cost, audit || CASE s WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit,
      out || CASE s WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE [] END AS out FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.n = e.idx),
b AS (SELECT DISTINCT ON (conv_id) * FROM z ORDER BY conv_id, cost, audit)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
