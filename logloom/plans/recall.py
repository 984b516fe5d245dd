"""Queries on requests, rendered messages and context figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts, many, recall, search, summary, windows
from ..sources import messages as M
from ..sources.sessions import table
from .catalog import BLOCKS, MESSAGES, PLACED, blocks, many_hits, query
from .catalog import messages as turns
from .transcripts import PATH, PLACES, WRITTEN, messages, parsed

#: A request made of each turn: references of all forms, and the turn's own words.
ASKED = "CASE conv_id % 9 WHEN 0 THEN '#' || turn WHEN 1 THEN '#' || turn || ':full' WHEN 2 THEN '#' || conv_id || ':' || turn || ':20' WHEN 3 THEN '#' || turn || ':text:' || conv_id WHEN 4 THEN '#' || turn || ':src/' || conv_id || '.ts' WHEN 5 THEN '#' || conv_id || ':a:' || turn || '.ts:10:' || turn WHEN 6 THEN '#' || turn || ':text:full' WHEN 7 THEN text ELSE '#' || turn || ' ' || role END"


@query(rf"""WITH q AS (SELECT conv_id AS c, turn AS i, {ASKED} AS q FROM conversations), k AS (SELECT *, CASE WHEN regexp_full_match(q, '#\d+(:(full|\d+(:\d+)?))?') THEN 'entry' WHEN regexp_full_match(q, '#\d+:text(:(full|\d+(:\d+)?))?') THEN 'text'
  WHEN regexp_full_match(q, '#\d+:.+') THEN 'file' ELSE 'search' END AS kind FROM q),
s AS (SELECT *, CASE kind WHEN 'entry' THEN regexp_extract(q, '^#\d+:(.*)$', 1) WHEN 'text' THEN regexp_extract(q, '^#\d+:text:(.*)$', 1) WHEN 'file' THEN regexp_extract(q, '^#\d+:.+?:(full|\d+(?::\d+)?)$', 1) END AS suffix FROM k)
SELECT c AS conv_id, i AS turn, kind, TRY_CAST(regexp_extract(q, '^#(\d+)', 1) AS BIGINT) AS index, CASE WHEN kind = 'file' THEN CASE WHEN suffix = '' THEN substr(q, strpos(q, ':') + 1) ELSE substr(q, strpos(q, ':') + 1, length(q) - strpos(q, ':') - length(suffix) - 1) END END AS pattern,
CASE WHEN kind <> 'search' THEN suffix = 'full' END AS "full", TRY_CAST(string_split(suffix, ':')[1] AS BIGINT) AS "offset", TRY_CAST(string_split(suffix, ':')[2] AS BIGINT) AS "limit" FROM s""")
def recall_references(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", recall.reference(F.expr(ASKED)).alias("r")).select("conv_id", "turn", "r.*")


#: Options put before, within and behind each turn's first words.
OPTED = "CASE conv_id % 7 WHEN 0 THEN 'scope:all ' ELSE '' END || CASE turn % 3 WHEN 0 THEN 'Mode:file ' WHEN 1 THEN 'mode:touched  ' ELSE '' END || substr(text, 1, 30) || CASE conv_id % 5 WHEN 0 THEN ' page:' || turn WHEN 1 THEN '  keep:3 and keep:' || turn WHEN 2 THEN ' telescope:all keep:x' ELSE '' END"


@query(rf"""WITH q AS (SELECT conv_id AS c, turn AS i, {OPTED} AS q FROM conversations), w AS (SELECT c, i, q, list_filter(string_split_regex(q, '\s+'), lambda x: x <> '') AS w FROM q),
l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM w)
SELECT c AS conv_id, i AS turn, array_to_string(list_filter(w, lambda x: NOT regexp_full_match(lower(x), '(scope:(lineage|all|active)|mode:(hybrid|touched|file)|page:\d+)')), ' ') AS query,
CASE WHEN list_contains(l, 'scope:all') THEN 'all' ELSE 'lineage' END AS scope, coalesce(substr(list_filter(l, lambda x: regexp_full_match(x, 'mode:(hybrid|touched|file)'))[1], 6), 'hybrid') AS mode,
greatest(coalesce(substr(list_filter(l, lambda x: regexp_full_match(x, 'page:\d+'))[1], 6)::BIGINT, 1), 1) AS page,
array_to_string(list_filter(CASE WHEN len(list_filter(l, lambda x: regexp_full_match(x, 'keep:\d+'))) > 0 THEN list_filter(w, lambda x: NOT regexp_full_match(lower(x), 'keep:\d+')) ELSE [trim(q)] END, lambda x: x <> ''), ' ') AS prompt,
substr(list_filter(l, lambda x: regexp_full_match(x, 'keep:\d+'))[-1], 6)::BIGINT AS keep FROM l""")
def recall_options(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.expr(OPTED).alias("q"))
    return asked.select("conv_id", "turn", recall.options(F.col("q")).alias("o"), recall.keep_options(F.col("q")).alias("k")).select("conv_id", "turn", "o.*", "k.prompt", "k.keep")


SHELL = "['npm test', 'git commit -m x', 'ls -la', 'make'][e % 4 + 1]"
CALL = f"CASE t WHEN 'view' THEN 'read' ELSE 'edit' END || '(path=' || {PATH} || ')' || chr(10)"


@query(f"""WITH {PLACES} SELECT session_id, source AS seq, CASE t WHEN 'signup' THEN 'user' WHEN 'error' THEN 'bash' WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN 'tool_result' ELSE 'assistant' END ELSE 'assistant' END AS role,
CASE t WHEN 'signup' THEN 'please fix the parser of step ' || e WHEN 'click' THEN 'Hmm, step ' || e || ' is done' WHEN 'purchase' THEN {CALL}
  WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN '[edit] ok ' || e ELSE {CALL} END ELSE '$ ' || {SHELL} || chr(10) || 'line ' || e END AS summary FROM v""")
def rendered_messages(spark, d):
    return messages(spark, d).select("session_id", "seq", M.rendered(F.col("message"), raw=F.col("raw")).alias("r")).select("session_id", "seq", "r.*")


DOCUMENT = f"""CASE t WHEN 'signup' THEN 'please fix the parser of step ' || e WHEN 'click' THEN 'Hmm, step ' || e || ' is done' || chr(10) || 't' || e
  WHEN 'purchase' THEN {PATH} || chr(10) || CASE WHEN e % 2 = 0 THEN 'a' || chr(10) || chr(10) || 'b' || chr(10) || 'c' || chr(10) ELSE 'x' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || chr(10) || 'w' END
  WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN 'ok ' || e ELSE {PATH} END ELSE {SHELL} || ' line ' || e END"""


@query(f"""WITH {PLACES} SELECT session_id, source AS seq, {DOCUMENT} AS doc FROM v""")
def search_documents(spark, d):
    return messages(spark, d).select("session_id", "seq", M.search_document(F.col("message"), raw=F.col("raw")).alias("doc"))


@query(f"""WITH {PLACES} SELECT session_id, source AS seq, CASE t WHEN 'signup' THEN 'please fix the parser of step ' || e || CASE WHEN e % 5 = 0 THEN chr(10) || '[image:image/png]' ELSE '' END WHEN 'click' THEN '[thinking]' || chr(10) || 'Hmm, step ' || e || ' is done'
  WHEN 'purchase' THEN '[toolCall:edit]' WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN 'ok ' || e ELSE '[toolCall:read]' END ELSE '' END AS preview,
CASE t WHEN 'signup' THEN ceil(length('please fix the parser of step ' || e) / 4) + CASE WHEN e % 5 = 0 THEN 1200 ELSE 0 END WHEN 'click' THEN ceil(length('t' || e) / 4) + ceil(length('Hmm, step ' || e || ' is done') / 4)
  WHEN 'error' THEN ceil((length({SHELL}) + 1 + length('line ' || e)) / 4) WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN ceil(length('ok ' || e) / 4) ELSE ceil((4 + length({WRITTEN})) / 4) END WHEN 'purchase' THEN ceil((4 + length({WRITTEN})) / 4) END::BIGINT AS tokens FROM v""")
def message_estimates(spark, d):
    m = F.col("message")
    return messages(spark, d).select("session_id", "seq", M.preview(m).alias("preview"), M.message_tokens(m, F.col("raw")).alias("tokens"))


@query("""WITH e AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text FROM conversations),
q AS (SELECT DISTINCT conv_id AS session_id, unnest([3, 0, 5]) AS idx FROM conversations)
SELECT q.session_id, CASE q.idx WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END::INT AS at, q.idx::BIGINT AS idx, e.role, e.idx IS NOT NULL AS available FROM q LEFT JOIN e ON e.session_id = q.session_id AND e.idx = q.idx""")
def expanded_entries(spark, d):
    from .catalog import entries

    rows = entries(spark, d).select(F.col("conv_id").alias("session_id"), "idx", "role")
    asked = rows.select("session_id").distinct().select("session_id", F.posexplode(F.array(*[F.lit(i).cast("long") for i in (3, 0, 5, 0)])).alias("at", "idx"))
    return recall.requested(rows, asked).select("session_id", "at", "idx", "role", "available")


@query("""WITH e AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations), q AS (SELECT DISTINCT conv_id AS session_id, unnest([3, 0, 5]) AS idx FROM conversations)
SELECT session_id, CASE idx WHEN 3 THEN 0 ELSE 2 END::INT AS at, idx::BIGINT AS idx FROM q WHERE idx <> 0 AND NOT EXISTS (FROM e WHERE e.session_id = q.session_id AND e.idx = q.idx)""")
def unavailable_entries(spark, d):
    from .catalog import entries

    rows = entries(spark, d).select(F.col("conv_id").alias("session_id"), "idx")
    asked = rows.select("session_id").distinct().select("session_id", F.posexplode(F.array(*[F.lit(i).cast("long") for i in (3, 0, 5, 0)])).alias("at", "idx"))
    return recall.unavailable(rows, asked)


@query("""WITH h AS (SELECT conv_id, turn, role, CASE WHEN length(text) <= 40 THEN text WHEN contains(text[1:41], ' ') AND 41 - strpos(reverse(text[1:41]), ' ') > 24 THEN text[1:41 - strpos(reverse(text[1:41]), ' ')] ELSE text[1:40] END AS body
FROM conversations WHERE contains(lower(text), 'stly')) SELECT CASE WHEN count(*) = 0 THEN 'No matches for "stly" in session history.' ELSE 'Found ' || count(*) || ' matches for "stly":' || chr(10) || chr(10)
|| string_agg('#' || turn || ' [' || role || '] files:[c' || conv_id || ']' || chr(10) || '  p' || turn || ' (read, 2 lines)' || chr(10) || '    a' || chr(10) || '    ...(1 lines below)' || chr(10) || body, chr(10) || chr(10) ORDER BY conv_id, turn) || chr(10) || chr(10) || '--- Use #N for full entry text ---' END AS output FROM h""")
def recall_output(spark, d):
    hits = table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("stly")))
    match = F.array(F.struct(F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), F.lit("read").alias("tool"), F.lit(2).alias("n_lines"), F.lit("a\n...(1 lines below)").alias("snippet")))
    shown = recall.hit_text(F.col("turn"), F.col("role"), F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string"))), match, T.clip(F.col("text"), 40))
    return recall.output(hits.select(F.struct("conv_id", "turn").alias("place"), shown.alias("shown"), F.lit(True).alias("clipped")), "stly")


@query(f"WITH {BLOCKS}, f AS (SELECT session_id, path, min(blk) AS blk FROM b WHERE kind = 'tool_call' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY blk) AS nth FROM f) SELECT session_id, path, nth::INT AS nth FROM r WHERE nth <= 10")
def top_files(spark, d):
    return recall.top_files(blocks(spark, d))


CUTS = f"""{MESSAGES}, {PLACED}, q AS (SELECT session_id, max(n) AS n, min(i) FILTER (role = 'user' AND back = 1) AS pos FROM p GROUP BY session_id),
x AS (SELECT *, max(CASE WHEN suffix >= 60 THEN i END) OVER (PARTITION BY session_id) AS crossed FROM p), u AS (SELECT session_id, coalesce(min(i) FILTER (crossed IS NOT NULL AND i >= greatest(crossed, 1) AND role <> 'toolResult'), -1) AS budget FROM x GROUP BY session_id),
c AS (SELECT q.session_id, q.n, CASE WHEN n <= 2 THEN 'too_few' WHEN pos > 0 THEN 'cut' ELSE 'compact_all' END AS outcome, CASE WHEN n <= 2 THEN NULL WHEN pos > 0 THEN pos ELSE n END AS cut, u.budget FROM q JOIN u USING (session_id)),
b AS (SELECT c.*, CASE WHEN outcome = 'compact_all' AND budget >= 0 THEN 'no_anchor' WHEN outcome = 'cut' AND p.suffix > 60 * 1.5 AND budget > cut THEN 'oversized_tail' END AS budget_cut FROM c LEFT JOIN p ON p.session_id = c.session_id AND p.i = c.cut)"""


@query(f"""WITH {CUTS} SELECT b.session_id, CASE WHEN budget_cut IS NOT NULL THEN 'cut' ELSE outcome END AS outcome, CASE WHEN budget_cut IS NOT NULL THEN budget ELSE cut END AS cut,
CASE WHEN budget_cut IS NOT NULL THEN (SELECT count(*) FROM p WHERE p.session_id = b.session_id AND p.i >= b.budget AND p.role = 'user') WHEN outcome = 'too_few' THEN NULL WHEN outcome = 'cut' THEN 1 ELSE 0 END::BIGINT AS kept_turns, budget_cut FROM b""")
def tail_budget(spark, d):
    return windows.tail_budget(turns(spark, d), 1, False, 60, 1.5)


@query(f"""WITH {MESSAGES}, {PLACED}, t AS (SELECT p.*, length(c.text) AS chars FROM p JOIN conversations c ON c.conv_id = p.session_id AND c.turn = p.seq), q AS (SELECT session_id, CASE WHEN max(n) > 2 THEN coalesce(nullif(min(i) FILTER (role = 'user' AND back = 1), 0), max(n)) END AS cut FROM p GROUP BY session_id),
s AS (SELECT t.session_id, sum(tokens)::BIGINT AS before, coalesce(sum(chars) FILTER (i < cut), 0)::BIGINT AS prefix_chars, coalesce(sum(tokens) FILTER (i >= cut), 0)::BIGINT AS kept_tokens FROM t JOIN q USING (session_id) WHERE cut IS NOT NULL GROUP BY t.session_id)
SELECT *, 50 + kept_tokens AS after, greatest(0, before - 50 - kept_tokens) AS saved, CASE WHEN before > 50 + kept_tokens THEN floor((before - 50 - kept_tokens) * 100 / before + 0.5) ELSE 0 END::BIGINT AS percent FROM s""")
def savings(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", T.script_tokens(F.col("text")).alias("tokens"), F.char_length("text").cast("long").alias("chars"))
    return windows.savings(rows, windows.cuts(rows, 1), F.lit(50))


CONTEXT = """g AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_id % 41 = 0 THEN 'compaction' WHEN event_id % 97 = 0 THEN 'reset_boundary' ELSE 'message' END AS type,
CASE WHEN event_id % 5 < 2 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'stop' END AS stop_reason, CASE WHEN event_id % 3 > 0 THEN 'm' || event_id % 3 END AS model, CASE WHEN event_id % 11 > 2 THEN event_id % 9000 ELSE 0 END AS context_tokens, event_id % 50 AS tokens FROM events)"""


@query(f"""WITH {CONTEXT}, b AS (SELECT session_id, max(seq) AS at FROM g WHERE type <> 'message' GROUP BY session_id),
a AS (SELECT g.session_id, max(g.seq) AS at FROM g LEFT JOIN b USING (session_id) WHERE g.type = 'message' AND g.role = 'assistant' AND g.stop_reason <> 'error' AND g.context_tokens > 0 AND g.seq > coalesce(b.at, -1) AND coalesce(g.model, 'm1') = 'm1' GROUP BY g.session_id)
SELECT a.session_id, (max(g.context_tokens) FILTER (g.seq = a.at) + coalesce(sum(g.tokens) FILTER (g.seq > a.at AND g.type = 'message'), 0))::BIGINT AS tokens FROM a JOIN g USING (session_id) GROUP BY a.session_id""")
def full_context_tokens(spark, d):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, d, "events").withColumn("seq", seq.cast("long")).selectExpr(
        "user_id AS session_id", "seq", "CASE WHEN event_id % 41 = 0 THEN 'compaction' WHEN event_id % 97 = 0 THEN 'reset_boundary' ELSE 'message' END AS type", "CASE WHEN event_id % 5 < 2 THEN 'assistant' ELSE 'user' END AS role",
        "CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'stop' END AS stop_reason", "CASE WHEN event_id % 3 > 0 THEN concat('m', event_id % 3) END AS model", "CASE WHEN event_id % 11 > 2 THEN event_id % 9000 ELSE 0 END AS context_tokens", "event_id % 50 AS tokens",
    )
    return windows.full_context_tokens(rows, "m1")


FILES = """f AS (SELECT user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'Modified' WHEN 'view' THEN 'Read' ELSE 'Created' END AS category, 'p' || event_id % 40 AS path, event_id % 2 AS side, min(event_id) AS first_blk FROM events WHERE event_type IN ('purchase', 'view', 'signup') GROUP BY ALL)"""


@query(f"""WITH {FILES}, o AS (SELECT session_id, category, path, min({{'side': side, 'blk': first_blk}}) AS pos FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY pos, path) AS first_blk FROM o)
SELECT session_id, category, path, first_blk FROM r WHERE category <> 'Created' OR NOT EXISTS (FROM r m WHERE m.session_id = r.session_id AND m.path = r.path AND m.category = 'Modified')""")
def merged_files(spark, d):
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'Modified' WHEN 'view' THEN 'Read' ELSE 'Created' END")
    rows = table(spark, d, "events").where("event_type in ('purchase', 'view', 'signup')").select(F.col("user_id").alias("session_id"), kind.alias("category"), F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string")).alias("path"), (F.col("event_id") % 2).alias("side"), "event_id")
    of = lambda side: rows.where(F.col("side") == side).groupBy("session_id", "category", "path").agg(F.min("event_id").alias("first_blk"))
    return summary.merged_files(of(0), of(1))


@query("""WITH l AS (SELECT user_id AS session_id, list('line ' || event_id % 23 ORDER BY event_id) FILTER (event_id % 3 = 0) AS p, list('line ' || event_id % 23 ORDER BY event_id) FILTER (event_id % 3 = 1 AND user_id % 4 > 0) AS f FROM events GROUP BY user_id),
u AS (SELECT session_id, coalesce(p, []) AS p, coalesce(f, []) AS f, list_concat(coalesce(p, []), coalesce(f, [])) AS a FROM l), k AS (SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM u)
SELECT session_id, array_to_string(CASE WHEN len(d) <= 8 THEN d ELSE list_concat(d[1:1], d[len(d) - 6:len(d)]) END, '|') AS goals, array_to_string(d[greatest(len(d) - 7, 1):len(d)], '|') AS commits,
array_to_string(CASE WHEN len(f) > 0 THEN f ELSE p END, '|') AS blockers, array_to_string(d[greatest(len(d) - 14, 1):len(d)], '|') AS preferences FROM k""")
def merged_sections(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id AS session_id", "event_id", "concat('line ', event_id % 23) AS line")
    names = ["goals", "commits", "blockers", "preferences"]

    def side(keep):
        lines = F.transform(F.array_sort(F.collect_list(F.when(F.expr(keep), F.struct("event_id", "line")))), lambda x: x["line"])
        per = rows.groupBy("session_id").agg(lines.alias("l"))
        return per.select("session_id", *[F.col("l").alias(n) for n in names], F.lit("").alias("brief"))

    merged = summary.merged_sections(side("event_id % 3 = 0"), side("event_id % 3 = 1 AND session_id % 4 > 0"))
    return merged.select("session_id", *[F.array_join(n, "|").alias(n) for n in names])


CHAIN = """e AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE 'e' || turn END AS entry_id, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
g AS (SELECT session_id, seq, conv_id_mod <> 5 OR seq > 0 AS append, seq = CASE WHEN conv_id_mod = 3 THEN 1 ELSE 0 END AS chain_start, seq + CASE WHEN conv_id_mod = 3 THEN 0 ELSE 1 END + CASE WHEN conv_id_mod = 2 AND seq = 1 THEN 1 ELSE 0 END AS sequence,
'e' || seq AS first_covered, 'e' || seq AS last_covered, CASE WHEN seq = last OR conv_id_mod = 1 THEN '' WHEN conv_id_mod = 4 AND seq = 1 THEN 'e0' ELSE 'e' || (seq + 1) END AS first_kept FROM (SELECT *, session_id % 7 AS conv_id_mod FROM e))"""


@query(f"""WITH {CHAIN}, s AS (SELECT session_id, max(seq) FILTER (append AND chain_start) AS start FROM g GROUP BY session_id), c AS (SELECT g.* FROM g JOIN s USING (session_id) WHERE g.seq >= s.start),
u AS (SELECT session_id, entry_id, min(seq) AS place FROM e GROUP BY ALL HAVING count(*) = 1),
o AS (SELECT c.session_id, c.seq, c.sequence, coalesce(c.append AND a.place <= b.place AND (c.first_kept = '' OR k.place > b.place) AND c.sequence = row_number() OVER w AND (lag(c.first_kept) OVER w IS NULL OR lag(c.first_kept) OVER w = '' OR lag(c.first_kept) OVER w = c.first_covered), false) AS ok
  FROM c LEFT JOIN u a ON a.session_id = c.session_id AND a.entry_id = c.first_covered LEFT JOIN u b ON b.session_id = c.session_id AND b.entry_id = c.last_covered LEFT JOIN u k ON k.session_id = c.session_id AND k.entry_id = c.first_kept WINDOW w AS (PARTITION BY c.session_id ORDER BY c.seq))
SELECT session_id, seq, sequence FROM o QUALIFY bool_and(ok) OVER (PARTITION BY session_id)""")
def active_chain(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id AS session_id", "turn AS seq", "CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE concat('e', turn) END AS entry_id", "max(turn) OVER (PARTITION BY conv_id) AS last", "conv_id % 7 AS k")
    made = rows.selectExpr(
        "session_id", "seq", "k <> 5 OR seq > 0 AS append", "seq = CASE WHEN k = 3 THEN 1 ELSE 0 END AS chain_start", "seq + CASE WHEN k = 3 THEN 0 ELSE 1 END + CASE WHEN k = 2 AND seq = 1 THEN 1 ELSE 0 END AS sequence",
        "concat('e', seq) AS first_covered", "concat('e', seq) AS last_covered", "CASE WHEN seq = last OR k = 1 THEN '' WHEN k = 4 AND seq = 1 THEN 'e0' ELSE concat('e', seq + 1) END AS first_kept",
    )
    return windows.active_chain(made, rows.select("session_id", "seq", "entry_id"))


READINGS = r"q\d o"


@query(r"""WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, replace(text, ' the ', CASE WHEN conv_id % 2 = 0 THEN ' q\d ' ELSE ' q7 ' END) AS doc FROM conversations),
k AS (SELECT conv_id, idx, regexp_matches(doc, '(?i)q\d o') AS p, contains(lower(doc), 'q\d o') AS l FROM e), p AS (SELECT conv_id, idx, row_number() OVER (ORDER BY conv_id, idx) AS rn FROM k WHERE p),
x AS (SELECT conv_id, idx, row_number() OVER (ORDER BY conv_id, idx) AS rn FROM k WHERE l AND NOT p), n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM x) AS nx)
SELECT conv_id, idx, 'pattern' AS reading FROM p, n WHERE rn <= 50 - least(nx, 25) UNION ALL SELECT conv_id, idx, 'literal' FROM x, n WHERE rn <= 50 - least(np, 50 - least(nx, 25))""")
def recall_both_readings(spark, d):
    """A word of every other conversation is made text that only the literal reading finds, of the others what only the pattern does."""
    from .catalog import entries

    doc = F.when(F.col("conv_id") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" q\\d "))).otherwise(F.replace("text", F.lit(" the "), F.lit(" q7 ")))
    return search.both_readings(entries(spark, d).withColumn("doc", doc), READINGS)


BRANCHED = """m AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn % 5 = 4 THEN 'twice' ELSE 'e' || turn END AS entry_id, role FROM conversations WHERE role <> 'system'),
g AS (SELECT session_id, entry_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY session_id, entry_id) AS n FROM m)"""


@query(f"WITH {BRANCHED} SELECT session_id, entry_id, idx FROM g WHERE n = 1 AND (session_id % 4 = 1 OR session_id % 4 IN (0, 3) AND entry_id IN (SELECT 'e' || k FROM (SELECT unnest(range(0, 1000, 2)) AS k)))")
def branch_scope(spark, d):
    """Sessions with a branch of even entries, without a branch, and with one that names no ids."""
    turns = table(spark, d, "conversations").where("role <> 'system'")
    rows = turns.selectExpr("conv_id AS session_id", "turn AS seq", "CASE WHEN turn % 5 = 4 THEN 'twice' ELSE concat('e', turn) END AS entry_id", "'message' AS type")
    branch = turns.where("conv_id % 4 <> 1").selectExpr("conv_id AS session_id", "CASE WHEN conv_id % 4 = 2 THEN '' WHEN turn % 2 = 0 THEN concat('e', turn) END AS entry_id")
    return windows.scoped(rows, branch)


@query(many_hits(rf"""{PLACES}, e AS (SELECT session_id, source AS idx, CASE t WHEN 'signup' THEN 'user' WHEN 'error' THEN 'bash' WHEN 'view' THEN CASE WHEN e % 3 = 0 THEN 'tool_result' ELSE 'assistant' END ELSE 'assistant' END || ' ' || {DOCUMENT} || ' '
  || CASE WHEN t = 'purchase' OR t = 'view' AND e % 3 <> 0 THEN {PATH} ELSE '' END AS doc FROM v),
told AS (SELECT session_id, 'goal' AS label, arg_min('please fix the parser of step ' || e, source) AS text FROM v WHERE t = 'signup' GROUP BY session_id UNION ALL SELECT session_id, 'file', arg_min({PATH}, source) FROM v WHERE t = 'purchase' OR t = 'view' AND e % 3 <> 0 GROUP BY session_id),
q0 AS (SELECT session_id, label, regexp_extract_all(text, '[\p{{L}}\p{{N}}_./-]{{3,}}')[1:6] AS w FROM told)"""))
def report_probes(spark, d):
    """Each session searched by its first goal and its first file, as its report does."""
    b = parsed(spark, d)
    file = b.where("kind = 'tool_call'").groupBy("session_id").agg(F.min_by("path", "blk").alias("file"))
    told = facts.goals(b).join(file, "session_id", "full_outer").withColumn("blockers", F.array().cast("array<string>"))
    return many.hit_counts(summary.entry_documents(messages(spark, d)), summary.probe_queries(told))
