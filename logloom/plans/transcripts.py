"""Queries on whole transcripts: messages as blocks, file operations, briefs, summaries and the way back to a source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import brief, drill, merging, summary, windows
from ..sources import messages as M
from ..sources.sessions import table
from ..sources.shared import written
from .catalog import BLOCKS, blocks, query

PLACES = "v AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS source, event_id AS e, event_type AS t FROM events)"
PATH = "'/repo/src/m' || e % 7 || '/f' || e % 40 || '.py'"
#: The arguments of calls as the log writes them.
WRITTEN = rf"""CASE t WHEN 'view' THEN '{{"file_path":"' || {PATH} || '"}}' ELSE '{{"path":"' || {PATH} || CASE WHEN e % 2 = 0 THEN '","oldText":"a\n","newText":"b\nc\n"}}' ELSE '","edits":[{{"oldText":"x","newText":"y"}},{{"newText":"z\n\nw"}}]}}' END END"""
PARSED = f"""{PLACES}, x AS (SELECT session_id, source, 0 AS pos, 'user' AS kind, 'please fix the parser of step ' || e AS text, NULL AS name, NULL AS path, NULL AS command, NULL AS exit_code FROM v WHERE t = 'signup'
  UNION ALL SELECT session_id, source, 1, 'user', '[image: image/png]', NULL, NULL, NULL, NULL FROM v WHERE t = 'signup' AND e % 5 = 0
  UNION ALL SELECT session_id, source, 0, 'thinking', 't' || e, NULL, NULL, NULL, NULL FROM v WHERE t = 'click'
  UNION ALL SELECT session_id, source, 1, 'assistant', 'Hmm, step ' || e || ' is done', NULL, NULL, NULL, NULL FROM v WHERE t = 'click'
  UNION ALL SELECT session_id, source, 0, 'tool_call', NULL, CASE t WHEN 'view' THEN 'read' ELSE 'edit' END, {PATH}, NULL, NULL FROM v WHERE t = 'purchase' OR t = 'view' AND e % 3 <> 0
  UNION ALL SELECT session_id, source, 0, 'tool_result', 'ok ' || e, 'edit', NULL, NULL, NULL FROM v WHERE t = 'view' AND e % 3 = 0
  UNION ALL SELECT session_id, source, 0, 'bash', NULL, NULL, NULL, ['npm test', 'git commit -m x', 'ls -la', 'make'][e % 4 + 1], e % 2 FROM v WHERE t = 'error')"""


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def messages(spark, d):
    return M.event_messages(table(spark, d, "events"))


def parsed(spark, d):
    return M.as_blocks(messages(spark, d))


def held(spark, d):
    """Blocks for queries that read them many times: parsed once, as a table, where the query's plan begins anew."""
    return written(parsed(spark, d))


@query(f"WITH {PARSED} SELECT session_id, source, row_number() OVER (PARTITION BY session_id ORDER BY source, pos) - 1 AS blk, kind, text, name, path, command, exit_code::INT AS exit_code FROM x")
def normalized_blocks(spark, d):
    return parsed(spark, d).drop("args", "output")


@query(f"""WITH {PLACES} SELECT session_id, count(*) AS n, count(*) FILTER (t = 'signup') AS users, count(*) FILTER (t IN ('click', 'purchase') OR t = 'view' AND e % 3 <> 0) AS assistants,
count(*) FILTER (t = 'purchase' OR t = 'view' AND e % 3 <> 0) AS tool_calls, coalesce(string_agg(DISTINCT CASE WHEN t = 'click' THEN 'm' || e % 3 END, ',' ORDER BY CASE WHEN t = 'click' THEN 'm' || e % 3 END), '') AS models,
sum(CASE WHEN t = 'signup' THEN length('please fix the parser of step ' || e) + CASE WHEN e % 5 = 0 THEN 4800 ELSE 0 END WHEN t = 'view' AND e % 3 = 0 THEN length('ok ' || e)
  WHEN t = 'error' THEN length(['npm test', 'git commit -m x', 'ls -la', 'make'][e % 4 + 1]) + 1 + length('line ' || e) ELSE 0 END)::BIGINT AS input_chars,
sum(CASE WHEN t = 'click' THEN length('t' || e) + length('Hmm, step ' || e || ' is done') WHEN t = 'purchase' OR t = 'view' AND e % 3 <> 0 THEN 4 + length({WRITTEN}) ELSE 0 END)::BIGINT AS output_chars,
sum(CASE WHEN t = 'click' THEN e % 50 ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN t = 'click' THEN e % 7 ELSE 0 END)::BIGINT AS output_tokens, sum(CASE WHEN t = 'click' THEN e % 11 ELSE 0 END)::BIGINT AS cache_read,
sum(CASE WHEN t = 'click' THEN e % 13 ELSE 0 END)::BIGINT AS cache_write, max(e * 7) FILTER (t = 'click') - min(e * 7) FILTER (t = 'click') AS span_ms FROM v GROUP BY session_id""")
def usage_stats(spark, d):
    return M.usage(messages(spark, d))


@query(f"""WITH {PLACES}, m AS (SELECT session_id, source AS seq, CASE WHEN source % 11 = 0 THEN '' WHEN source % 7 = 0 THEN 'twice' ELSE 'm' || source END AS id, t = 'error' OR t = 'view' AND e % 3 = 0 AS output,
  t IN ('click', 'purchase') OR t = 'view' AND e % 3 <> 0 AS done, CASE WHEN t = 'error' THEN ceil(length('line ' || e) / 4) ELSE ceil(length('ok ' || e) / 4) END::BIGINT AS tokens FROM v),
b AS (SELECT session_id, max(seq) AS last_done FROM m WHERE done GROUP BY session_id),
u AS (SELECT session_id, id FROM m WHERE id <> '' GROUP BY ALL HAVING count(*) = 1),
o AS (SELECT m.*, b.last_done IS NULL OR m.seq > b.last_done AS pending, u.id IS NOT NULL AS once FROM m LEFT JOIN b ON b.session_id = m.session_id LEFT JOIN u ON u.session_id = m.session_id AND u.id = m.id WHERE m.output),
c AS (SELECT session_id, seq, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY seq DESC) AS spent FROM o WHERE NOT pending AND once),
k AS (SELECT session_id, max(seq) AS broken FROM c WHERE tokens > 2 AND spent > 40 GROUP BY session_id)
SELECT o.session_id, o.seq, o.tokens, o.pending OR NOT o.once OR o.tokens <= 2 OR k.broken IS NULL OR o.seq > k.broken AS kept, o.pending, count(*) FILTER (o.pending) OVER (PARTITION BY o.session_id) AS n_pending
FROM o LEFT JOIN k ON k.session_id = o.session_id""")
def tool_output_projection(spark, d):
    ids = F.expr("CASE WHEN seq % 11 = 0 THEN '' WHEN seq % 7 = 0 THEN 'twice' ELSE concat('m', seq) END")
    return windows.output_projection(M.outputs(messages(spark, d).withColumn("id", ids)), 40, 2)


@query(f"WITH {PLACES} SELECT session_id, source, 'edit' AS name, {PATH} AS path, CASE WHEN e % 2 = 0 THEN 3 ELSE 4 END AS n_lines FROM v WHERE t = 'purchase'")
def file_indicators(spark, d):
    return M.file_operations(parsed(spark, d)).select("session_id", "source", "name", "path", "n_lines")


@query(f"""WITH {PLACES} SELECT session_id, source, {PATH} AS path, 'edit' AS name, 1 AS n_lines, '...(2 lines above)' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || chr(10) || '...(2 lines below)' AS snippet FROM v WHERE t = 'purchase' AND e % 2 = 1""")
def file_search(spark, d):
    return drill.file_hits(M.file_operations(parsed(spark, d)), r"\bz\b")


@query(f"""WITH {PLACES} SELECT session_id || ':' || source AS request_id, 1::BIGINT AS n_matches, {PATH} AS paths, {PATH} AS path, 'edit' AS tool, CASE WHEN e % 2 = 0 THEN 7 ELSE 11 END AS total_lines,
CASE WHEN e % 2 = 0 THEN 'a' || chr(10) ELSE 'x' || chr(10) || '--- becomes ---' END AS shown FROM v WHERE t = 'purchase'""")
def file_drill_down(spark, d):
    operations = M.file_operations(parsed(spark, d))
    asked = table(spark, d, "events").withColumn("source", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")).where("event_type = 'purchase'")
    asked = asked.selectExpr("concat(user_id, ':', source) AS request_id", "user_id AS session_id", "source", "concat('/f', event_id % 40, '.py') AS pattern", "false AS full", "1 AS offset", "2 AS limit")
    return drill.expand_files(operations, asked)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 1 THEN 2 END::INT AS first_line, CASE WHEN len(l) > 1 THEN least(4, len(l)) END::INT AS last_line,
len(l)::INT AS total_lines, CASE WHEN len(l) > 1 THEN array_to_string(l[2:4], chr(10)) END AS shown FROM l""")
def entry_window(spark, d):
    return table(spark, d, "documents").select("doc_id", drill.line_window(F.col("text"), F.lit(1), F.lit(3)).alias("w")).select("doc_id", "w.*")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'stly')), true) AS p FROM documents),
w AS (SELECT *, greatest(p - 2, 1) AS lo, least(p + 2, len(l)) AS hi FROM l WHERE p > 0),
c AS (SELECT *, list_transform(list_transform(l[lo:hi], lambda x: {'x': x, 'n': length(x), 's': least(greatest(greatest(strpos(x, 'stly') - 1, 0) - floor((1936 - CASE WHEN contains(x, 'stly') THEN 4 ELSE 0 END) / 2), 0), length(x) - 1936)::BIGINT}),
  lambda y: CASE WHEN y.n <= 2000 THEN y.x ELSE CASE WHEN y.s > 0 THEN '...(' || y.s || ' chars before)' ELSE '' END || y.x[y.s + 1:y.s + 1936] || CASE WHEN y.n - y.s - 1936 > 0 THEN '...(' || (y.n - y.s - 1936) || ' chars after)' ELSE '' END END) AS k FROM w)
SELECT doc_id, CASE WHEN lo > 1 THEN '...(' || (lo - 1) || ' lines above)' || chr(10) ELSE '' END || array_to_string(k, chr(10)) || CASE WHEN hi < len(l) THEN chr(10) || '...(' || (len(l) - hi) || ' lines below)' ELSE '' END AS snippet FROM c""")
def line_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_snippet(F.col("text"), "stly").alias("snippet")).where("snippet is not null")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_./-]{3,}')[1:6], ' ') AS query FROM documents")
def probe_queries(spark, d):
    return table(spark, d, "documents").select("doc_id", T.query_of(F.col("text")).alias("query"))


@query(r"""WITH x AS (SELECT doc_id, text, regexp_extract(text[1:200], '^([\s\S]*[.!?])(?:\s|$)', 1) AS s FROM documents) SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN length(s) >= 100 THEN s
WHEN contains(text[1:201], ' ') AND 201 - strpos(reverse(text[1:201]), ' ') > 120 THEN text[1:201 - strpos(reverse(text[1:201]), ' ')] ELSE text[1:200] END AS clipped FROM x""")
def clip_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip_sentence(F.col("text")).alias("clipped"))


TIERS = "m AS (SELECT conv_id AS session_id, turn AS place, CASE WHEN conv_id % 3 = 0 THEN 'e' || turn ELSE 'e' END AS entry_id, CASE WHEN conv_id % 3 = 1 THEN 'c' || turn ELSE 'c' END AS call_id, text AS serialized FROM conversations)"


@query(f"""WITH {TIERS}, a AS (SELECT session_id, entry_id, min(place) AS t FROM m GROUP BY ALL HAVING count(*) = 1), b AS (SELECT session_id, call_id, min(place) AS t FROM m GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT session_id, serialized, min(place) AS t FROM m GROUP BY ALL HAVING count(*) = 1)
SELECT m.session_id, m.place, coalesce(a.t, b.t, c.t) AS target FROM m LEFT JOIN a USING (session_id, entry_id) LEFT JOIN b USING (session_id, call_id) LEFT JOIN c USING (session_id, serialized)""")
def omission_targets(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id AS session_id", "turn AS place", "CASE WHEN conv_id % 3 = 0 THEN concat('e', turn) ELSE 'e' END AS entry_id", "CASE WHEN conv_id % 3 = 1 THEN concat('c', turn) ELSE 'c' END AS call_id", "text AS serialized")
    return drill.omission_targets(rows, rows).select("session_id", "place", "target")


@query("""WITH m AS (SELECT conv_id AS session_id, turn AS place, text, role = 'system' AS s, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT session_id, place, 0::BIGINT AS part, text FROM m WHERE NOT s OR n <> 1 OR NOT EXISTS (FROM conversations a WHERE a.conv_id = m.session_id AND a.role = 'assistant') UNION ALL SELECT m.session_id, place, g.turn, g.text FROM m JOIN conversations g ON g.conv_id = m.session_id AND g.role = 'assistant' WHERE s AND n = 1""")
def context_chain(spark, d):
    turns = table(spark, d, "conversations")
    rows = turns.selectExpr("conv_id AS session_id", "turn AS place", "text", "role = 'system' AS summary")
    return drill.with_chain(rows, turns.where("role = 'assistant'").selectExpr("conv_id AS session_id", "turn AS sequence", "text AS summary"))


@query(f"""WITH m AS (SELECT conv_id AS session_id, turn AS place, CASE WHEN role = 'system' THEN 'compactionSummary' WHEN conv_id % 5 = 0 AND turn = 1 THEN 'branchSummary' ELSE role END AS role, text FROM conversations),
c AS (SELECT session_id, max(text) FILTER (role = 'compactionSummary') AS told FROM m GROUP BY session_id), h AS (SELECT m.*, c.told, coalesce(m.role IN ('compactionSummary', 'branchSummary') AND m.text = c.told, false) AS hit FROM m JOIN c USING (session_id)),
o AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY session_id) = 1 AND hit AS swap FROM h), g AS (SELECT session_id, place AS part, text, row_number() OVER (PARTITION BY session_id ORDER BY place) AS nth FROM m WHERE role = 'assistant' AND session_id % 3 > 0)
SELECT session_id, place, 0::BIGINT AS part, role, text FROM o WHERE NOT swap
UNION ALL SELECT o.session_id, o.place, g.part, 'append-segment', CASE WHEN g.nth = 1 THEN {_quoted(drill.FRAME_OPEN)} ELSE '' END || g.text FROM o JOIN g ON g.session_id = o.session_id WHERE o.swap
UNION ALL SELECT session_id, place, 4611686018427387904, 'append-trailing', CASE WHEN EXISTS (FROM g WHERE g.session_id = o.session_id) THEN '' ELSE {_quoted(drill.FRAME_OPEN)} END || told || {_quoted(drill.FRAME_CLOSE)} FROM o WHERE swap""")
def projected_context(spark, d):
    """Conversations whose system turn is the newest summary, with a chain of their assistants' turns or none, projected twice."""
    turns = table(spark, d, "conversations")
    rows = turns.selectExpr("conv_id AS session_id", "turn AS place", "CASE WHEN role = 'system' THEN 'compactionSummary' WHEN conv_id % 5 = 0 AND turn = 1 THEN 'branchSummary' ELSE role END AS role", "text")
    segments = rows.where("role = 'assistant' and session_id % 3 > 0").selectExpr("session_id", "place AS sequence", "text AS summary")
    chains = rows.where("role = 'compactionSummary'").groupBy("session_id").agg(F.max("text").alias("trailing"))
    once = drill.projected(rows, segments, chains)
    again = drill.projected(once.select("session_id", F.struct("place", "part").alias("place"), "role", "text"), segments, chains)
    return again.select("session_id", "place.place", "place.part", "role", "text")


@query("""WITH s AS (SELECT conv_id, turn, text, floor(greatest(900 - 200 * count(*) OVER (PARTITION BY conv_id), 0) / count(*) OVER (PARTITION BY conv_id))::INT AS share FROM conversations)
SELECT conv_id, turn, text[1:share] AS shown, length(text) > share AS cut FROM s""")
def recall_allotment(spark, d):
    return drill.allotted(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "text", 900).drop("text")


@query(f"""WITH {BLOCKS}, f AS (SELECT session_id, CASE name WHEN 'edit' THEN 'Modified' ELSE 'Read' END AS category, path, min(blk) AS first_blk FROM b WHERE path IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY first_blk, path) AS nr, count(*) OVER (PARTITION BY session_id, category) AS n, string_split(path, '/')[4] AS m FROM f),
p AS (SELECT session_id, category, CASE WHEN count(*) < 2 THEN '' WHEN count(DISTINCT m) = 1 THEN '/repo/src/' || min(m) || '/' ELSE '/repo/src/' END AS dir FROM r GROUP BY ALL),
g AS (SELECT session_id, category, min(nr) AS nr, category || CASE WHEN dir <> '' THEN ' (in ' || dir || ')' ELSE '' END || ': ' || string_agg(substr(path, length(dir) + 1), ', ' ORDER BY nr) AS line FROM r JOIN p USING (session_id, category) WHERE nr <= 20 GROUP BY session_id, category, dir
UNION ALL SELECT session_id, category, min(nr), category || ' (+' || count(*) || ' more under /repo/src/' || m || '/): ' || string_agg(string_split(path, '/')[5], ', ' ORDER BY nr) FROM r WHERE nr BETWEEN 21 AND 100 GROUP BY session_id, category, m
UNION ALL SELECT session_id, category, 101, category || ' (+' || (n - 100) || ' more)' FROM r WHERE nr = 101)
SELECT session_id, category, row_number() OVER (PARTITION BY session_id, category ORDER BY nr)::INT AS nth, line FROM g""")
def file_category_lines(spark, d):
    return summary.category_lines(summary.touched_files(blocks(spark, d)))


#: Files of two sides of a session, and the file lines of both as one, with commas in names; each user's side 0 is the previous summary.
SIDES = r"""v AS (SELECT user_id::VARCHAR AS session_id, event_id AS e, event_id % 2 AS side, CASE event_type WHEN 'purchase' THEN 'Modified' WHEN 'view' THEN 'Read' ELSE 'Created' END AS category,
  '/repo/src/m' || event_id % 7 || '/f' || event_id % 40 || ',x.py' AS path, CASE event_type WHEN 'click' THEN 'g' ELSE 'n' END || event_id % 29 || ' ' || repeat('word ', (event_id % 40)::INT) || 'end' AS line, event_type AS t FROM events),
f0 AS (SELECT session_id, side, category, path, min(e) AS e FROM v WHERE t IN ('purchase', 'view', 'signup') GROUP BY ALL),
f1 AS (SELECT f0.*, row_number() OVER (PARTITION BY session_id, side, category ORDER BY e, path) AS nr FROM f0 WHERE category <> 'Created' OR NOT EXISTS (FROM f0 m WHERE m.session_id = f0.session_id AND m.side = f0.side AND m.path = f0.path AND m.category = 'Modified')),
f2 AS (SELECT session_id, category, path, min({'side': side, 'nr': nr}) AS pos FROM f1 WHERE nr <= 100 GROUP BY ALL),
files AS (SELECT f2.session_id, f2.category, f2.path, row_number() OVER (PARTITION BY session_id, category ORDER BY pos, path) AS nr FROM f2 WHERE category <> 'Created' OR NOT EXISTS (FROM f2 m WHERE m.session_id = f2.session_id AND m.path = f2.path AND m.category = 'Modified'))"""


def two_sides(spark, d):
    """session_id, side, t, e, category, path, line of events, as two summaries of each user tell them."""
    return table(spark, d, "events").selectExpr(
        "cast(user_id AS string) AS session_id", "event_id % 2 AS side", "event_type AS t", "event_id AS e", "CASE event_type WHEN 'purchase' THEN 'Modified' WHEN 'view' THEN 'Read' ELSE 'Created' END AS category",
        "concat('/repo/src/m', event_id % 7, '/f', event_id % 40, ',x.py') AS path", "concat(CASE event_type WHEN 'click' THEN 'g' ELSE 'n' END, event_id % 29, ' ', repeat('word ', cast(event_id % 40 AS int)), 'end') AS line",
    )


def told(rows, side):
    """session_id, summary: what a side's rows say, wrapped as summaries are."""
    own = rows.where(F.col("side") == side)
    files = own.where("t IN ('purchase', 'view', 'signup')").groupBy("session_id", "category", "path").agg(F.min("e").alias("first_blk"))
    listed = lambda kind, title: F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") == kind, F.struct("e", "line")))), lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    per = own.groupBy("session_id").agg(listed("click", summary.TITLES["goals"]).alias("goals"), listed("error", summary.TITLES["commits"]).alias("commits"), F.count("*").alias("n"))
    whole = per.join(merging.file_section(summary.created_unmodified(files)), "session_id", "left")
    text = F.concat(F.concat_ws("\n\n", "goals", "files", "commits"), F.lit(summary.RULE), F.lit("[user]\nstep "), F.col("n").cast("string"))
    return whole.select("session_id", F.concat(brief.T.wrapped(text), F.lit(summary.RULE + summary.NOTE)).alias("summary"))


@query(f"""WITH {SIDES}, l AS (SELECT session_id, side, t, list('- ' || line ORDER BY e) AS l FROM v WHERE t IN ('click', 'error') GROUP BY ALL),
u AS (SELECT s.session_id, s.t, coalesce(a.l, []) AS a, coalesce(b.l, []) AS b FROM (SELECT DISTINCT session_id, t FROM l) s LEFT JOIN l a ON a.session_id = s.session_id AND a.t = s.t AND a.side = 0 LEFT JOIN l b ON b.session_id = s.session_id AND b.t = s.t AND b.side = 1),
k AS (SELECT session_id, t, a, b, list_filter(list_concat(a, b), lambda x, i: list_position(list_concat(a, b), x) = i) AS d FROM u),
m AS (SELECT session_id, t, CASE WHEN len(a) = 0 OR len(b) = 0 THEN list_concat(a, b) WHEN len(d) <= 8 THEN d WHEN t = 'click' THEN list_concat(d[1:1], d[len(d) - 6:len(d)]) ELSE d[len(d) - 7:len(d)] END AS l FROM k),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id, category) AS n, string_split(path, '/')[4] AS m FROM files), p AS (SELECT session_id, category, CASE WHEN count(*) < 2 THEN '' WHEN count(DISTINCT m) = 1 THEN '/repo/src/' || min(m) || '/' ELSE '/repo/src/' END AS dir FROM r GROUP BY ALL),
g AS (SELECT session_id, category, min(nr) AS nr, category || CASE WHEN dir <> '' THEN ' (in ' || dir || ')' ELSE '' END || ': ' || string_agg(replace(substr(path, length(dir) + 1), ',', chr(92) || ','), ', ' ORDER BY nr) AS line FROM r JOIN p USING (session_id, category) WHERE nr <= 20 GROUP BY session_id, category, dir
UNION ALL SELECT session_id, category, min(nr), category || ' (+' || count(*) || ' more under /repo/src/' || m || '/): ' || string_agg(replace(string_split(path, '/')[5], ',', chr(92) || ','), ', ' ORDER BY nr) FROM r WHERE nr BETWEEN 21 AND 100 GROUP BY session_id, category, m
UNION ALL SELECT session_id, category, 101, category || ' (+' || (n - 100) || ' more)' FROM r WHERE nr = 101),
c AS (SELECT session_id, string_agg('- ' || line, '|' ORDER BY category <> 'Modified', category, nr) AS files FROM g GROUP BY session_id),
n AS (SELECT session_id, string_agg('[user]' || chr(10) || 'step ' || n, chr(10) || chr(10) ORDER BY side) AS brief FROM (SELECT session_id, side, count(*) AS n FROM v GROUP BY ALL) GROUP BY session_id)
SELECT n.session_id, coalesce(array_to_string(x.l, '|'), '') AS goals, coalesce(c.files, '') AS files, coalesce(array_to_string(y.l, '|'), '') AS commits, brief
FROM n LEFT JOIN c USING (session_id) LEFT JOIN m x ON x.session_id = n.session_id AND x.t = 'click' LEFT JOIN m y ON y.session_id = n.session_id AND y.t = 'error'""")
def merged_summaries(spark, d):
    """Two rendered summaries of each user, read back from their text, merged, and read back once more."""
    rows = two_sides(spark, d)
    merged = merging.merged_summaries(told(rows, 0), told(rows, 1))
    part = lambda name: F.array_join(merging.bullets(merging.section(F.col("summary"), summary.TITLES[name])), "|")
    return merged.select("session_id", part("goals").alias("goals"), part("files").alias("files"), part("commits").alias("commits"), merging.brief_of(summary.without_note(F.col("summary"))).alias("brief"))


@query()
def ranked_selection(spark, d):
    return brief.selected(held(spark, d))


BRIEF = f"""{PARSED}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY source, pos) - 1 AS blk FROM x),
i AS (SELECT *, sum((kind IN ('tool_call', 'user'))::INT) OVER (PARTITION BY session_id ORDER BY blk) AS island FROM b), c AS (SELECT session_id, island, name FROM i WHERE kind = 'tool_call'),
r AS (SELECT i.session_id, i.island, arg_min(i.source, i.blk) AS result FROM i JOIN c ON c.session_id = i.session_id AND c.island = i.island AND c.name = i.name WHERE i.kind = 'tool_result' GROUP BY ALL),
s AS (SELECT i.session_id, i.blk, CASE WHEN kind IN ('user', 'bash') THEN '[user]' ELSE '[assistant]' END AS header, kind = 'tool_call' AS tool, CASE kind WHEN 'user' THEN text || ' (#' || source || ')' WHEN 'bash' THEN '$ ' || command || ' (#' || source || ')'
  WHEN 'assistant' THEN substr(text, 6) || ' (#' || source || ')' ELSE '* ' || name || ' "' || path || '"' END AS line, CASE WHEN kind = 'tool_call' THEN list_filter(['#' || source, 'result #' || result], lambda z: z IS NOT NULL) END AS refs
  FROM i LEFT JOIN r ON r.session_id = i.session_id AND r.island = i.island AND i.kind = 'tool_call' WHERE kind NOT IN ('thinking', 'tool_result')),
f AS (SELECT *, coalesce(lag(header) OVER w <> header, true) AS fresh, lag(tool) OVER w AND lag(line) OVER w = line AND tool AS same FROM s WINDOW w AS (PARTITION BY session_id ORDER BY blk)),
g AS (SELECT *, sum(fresh::INT) OVER w AS section, sum((fresh OR NOT coalesce(same, false))::INT) OVER w AS run FROM f WINDOW w AS (PARTITION BY session_id ORDER BY blk)),
m AS (SELECT session_id, section, run, any_value(header) AS header, any_value(tool) AS tool, any_value(line) AS line, count(*) AS times, flatten(list(refs ORDER BY blk) FILTER (tool)) AS refs FROM g GROUP BY session_id, section, run),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, section, tool ORDER BY run DESC) AS back, count(*) OVER (PARTITION BY session_id, section, tool) AS calls FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, section ORDER BY run) = 1 AS first FROM k WHERE NOT tool OR back <= 8),
z AS (SELECT session_id, run, list_concat(CASE WHEN first AND section > 1 THEN ['', header] WHEN first THEN [header] ELSE [] END, CASE WHEN tool AND back = 8 AND calls > 8 THEN ['* (' || (calls - 8) || ' earlier tool-call entries omitted)'] ELSE [] END,
  [CASE WHEN tool THEN line || ' (' || array_to_string(list_filter(refs, lambda y, j: list_position(refs, y) = j), ', ') || ')' || CASE WHEN times > 1 THEN ' x' || times ELSE '' END ELSE line END]) AS l FROM o),
e AS (SELECT session_id, run, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM z)"""


@query(f"WITH {BRIEF} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY run, k) AS n, line, count(*) OVER (PARTITION BY session_id) AS total FROM e")
def brief_transcript(spark, d):
    return brief.lines(held(spark, d))


@query(f"""WITH {BRIEF}, n AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY run, k) AS n, line, count(*) OVER (PARTITION BY session_id) AS total FROM e),
t AS (SELECT *, min(n) FILTER (regexp_matches(line, '^\\[.+\\]')) OVER (PARTITION BY session_id) AS start FROM n WHERE n > total - 120),
br AS (SELECT session_id, CASE WHEN max(total) > count(*) THEN '...(' || (max(total) - count(*)) || ' earlier lines omitted)' || chr(10) || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY n) AS brief FROM t WHERE total <= 120 OR start IS NULL OR n >= start GROUP BY session_id),
u AS (SELECT session_id, min(source) AS lo, max(source) AS hi, arg_min(text, source) AS first, arg_max(text, source) AS last FROM x WHERE kind = 'user' AND pos = 0 GROUP BY session_id),
go AS (SELECT session_id, '- ' || first || CASE WHEN hi > lo THEN '|- [Scope change]|- ' || last ELSE '' END AS goals FROM u), co AS (SELECT DISTINCT session_id, '- x' AS commits FROM x WHERE command = 'git commit -m x'),
fl AS (SELECT session_id, CASE name WHEN 'edit' THEN 'Modified' ELSE 'Read' END AS category, path, min(source) AS first_blk FROM x WHERE kind = 'tool_call' GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY first_blk, path) AS nr, count(*) OVER (PARTITION BY session_id, category) AS cnt, string_split(path, '/')[4] AS m FROM fl),
fp AS (SELECT session_id, category, CASE WHEN count(*) < 2 THEN '' WHEN count(DISTINCT m) = 1 THEN '/repo/src/' || min(m) || '/' ELSE '/repo/src/' END AS dir FROM fr GROUP BY ALL),
fg AS (SELECT session_id, category, min(nr) AS nr, category || CASE WHEN dir <> '' THEN ' (in ' || dir || ')' ELSE '' END || ': ' || string_agg(substr(path, length(dir) + 1), ', ' ORDER BY nr) AS line FROM fr JOIN fp USING (session_id, category) WHERE nr <= 20 GROUP BY session_id, category, dir
UNION ALL SELECT session_id, category, min(nr), category || ' (+' || count(*) || ' more under /repo/src/' || m || '/): ' || string_agg(string_split(path, '/')[5], ', ' ORDER BY nr) FROM fr WHERE nr BETWEEN 21 AND 100 GROUP BY session_id, category, m
UNION ALL SELECT session_id, category, 101, category || ' (+' || (cnt - 100) || ' more)' FROM fr WHERE nr = 101), fi AS (SELECT session_id, string_agg('- ' || line, '|' ORDER BY category, nr) AS files FROM fg GROUP BY session_id)
SELECT s.session_id, coalesce(goals, '') AS goals, coalesce(files, '') AS files, coalesce(commits, '') AS commits, '' AS blockers, coalesce(brief, '') AS brief
FROM (SELECT DISTINCT session_id FROM x) s LEFT JOIN go USING (session_id) LEFT JOIN fi USING (session_id) LEFT JOIN co USING (session_id) LEFT JOIN br USING (session_id)""")
def whole_summaries(spark, d):
    """Summaries with whole briefs, wrapped and with their note, taken apart again."""
    made = summary.summaries(held(spark, d), ranked=False).select("session_id", summary.without_note(F.col("summary")).alias("s"))
    part = lambda name: F.array_join(merging.bullets(merging.section(F.col("s"), summary.TITLES[name])), "|")
    return made.select("session_id", *[part(n).alias(n) for n in ("goals", "files", "commits", "blockers")], merging.brief_of(F.col("s")).alias("brief"))


@query()
def compact_summary(spark, d):
    return summary.summaries(held(spark, d)).select("session_id", "summary", "brief_lines")


@query()
def compact_report(spark, d):
    return summary.reports(messages(spark, d), held(spark, d))
