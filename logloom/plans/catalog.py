"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import text as T
from ..operators import blocks as B
from ..operators import facts, many, search, windows
from ..sources.sessions import conversation_entries, event_blocks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MULTI, SINGLE, MIXED, PATTERN, PATH = "thing stly reti", "thing", "th[ei]+ng zq+ stly", "th[ei]+ng.*stly", r"\w+stly\b"

#: Parts of the SQL.
ENTRIES = "e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text, concat_ws(' ', role, coalesce(text, ''), '') AS doc FROM conversations)"
BLOCKS = """b AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS blk, event_id,
  CASE event_type WHEN 'signup' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'bash' ELSE 'tool_call' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'read' END AS name,
  CASE WHEN event_type IN ('purchase', 'view') THEN '/repo/src/m' || event_id % 7 || '/f' || event_id % 40 || '.py' END AS path,
  CASE WHEN event_type = 'error' THEN ['npm test', 'git commit -m x', 'ls -la', 'make'][event_id % 4 + 1] END AS command,
  CASE WHEN event_type = 'error' THEN event_id % 2 END AS exit_code, repeat('line ' || event_id || '. ', (event_id % 20)::INT) AS text, event_id % 900 AS tokens FROM events)"""
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7FF}\x{3000}-\x{303F}]"


def _tokens(x: str) -> str:
    other = f"length(regexp_replace(coalesce({x}, ''), '{CJK}', '', 'g'))"
    return f"(length(coalesce({x}, '')) - {other} + ceil({other} / 4))::BIGINT"


MESSAGES = f"m AS (SELECT conv_id AS session_id, turn AS seq, role, {_tokens('text')} AS tokens FROM conversations)"
PLACED = """p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n,
  sum(tokens) OVER (PARTITION BY session_id ORDER BY seq DESC) AS suffix, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM m)"""
LOG = """l AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, 'e' || event_id AS entry_id,
  CASE WHEN event_id % 41 = 0 THEN 'compaction' WHEN event_id % 97 = 0 THEN 'reset_boundary' WHEN event_id % 13 = 0 THEN 'custom_message' ELSE 'message' END AS type,
  'e' || lag(event_id, (event_id % 9 + 1)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kept_before FROM events),
  g AS (SELECT *, CASE WHEN type = 'compaction' THEN coalesce(kept_before, '') END AS first_kept FROM l)"""


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def entries(spark: SparkSession, d: str) -> DataFrame:
    return conversation_entries(table(spark, d, "conversations"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return event_blocks(table(spark, d, "events"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", T.script_tokens(F.col("text")).alias("tokens"))


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.expr("CASE WHEN event_id % 41 = 0 THEN 'compaction' WHEN event_id % 97 = 0 THEN 'reset_boundary' WHEN event_id % 13 = 0 THEN 'custom_message' ELSE 'message' END")
    before = F.coalesce(*[F.when(F.col("event_id") % 9 == k, F.lag("event_id", k + 1).over(w)) for k in range(9)])
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.concat(F.lit("e"), "event_id").alias("entry_id"), kind.alias("type"), F.concat(F.lit("e"), before).alias("before"))
    return rows.withColumn("first_kept", F.when(F.col("type") == "compaction", F.coalesce("before", F.lit("")))).drop("before")


def _hits(q: str) -> str:
    """CTEs of all scored hits of a query, with probability and coverage."""
    terms = R.query_terms(q)
    count = lambda t: f"len(regexp_extract_all(doc, '(?i){t}'))" if R.looks_like_regex(t) else f"((length(lower(doc)) - length(replace(lower(doc), '{t.lower()}', ''))) / {len(t)})::BIGINT"
    tf = ", ".join(f"{count(t)} AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5e0) / (df{i} + 0.5e0) + 1) * tf{i} * 2.2e0 / (tf{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl)) ELSE 0 END" for i in range(len(terms)))
    total, cover = " + ".join(f"tf{i}" for i in range(len(terms))), " + ".join(f"(tf{i} > 0)::INT" for i in range(len(terms)))
    return f"""{ENTRIES}, f AS (SELECT *, len(regexp_extract_all(doc, '[\\p{{L}}\\p{{N}}_]+')) AS dl, {tf} FROM e),
    s AS (SELECT count(*) AS n, avg(dl) AS avg_dl, {df} FROM f),
    h AS (SELECT conv_id, idx, role, text, {part} AS score, {total} AS tf, {cover} AS coverage, dl / avg_dl AS ratio FROM f, s WHERE {total} > 0),
    a AS (SELECT CASE WHEN stddev_pop(score) > 0 THEN 1 / stddev_pop(score) ELSE 1 END AS alpha, median(score) AS beta, max(coverage) AS best FROM h WHERE score > 0),
    k AS (SELECT *, 1 / (1 + exp(-alpha * (score - beta))) AS l, greatest(0.1e0, least(0.9e0, 0.7e0 * (0.2e0 + 0.7e0 * least(1, tf / 10)) + 0.3e0 * (0.3e0 + 0.6e0 * (1 - least(1, abs(ratio - 0.5e0) * 2))))) AS pr FROM h, a),
    c AS (SELECT *, l * pr / (l * pr + (1 - l) * (1 - pr)) AS probability, row_number() OVER (ORDER BY score DESC, conv_id, idx) AS rk FROM k)"""


def _top(q: str, gate: bool, lo: int = 1, hi: int = 50) -> str:
    keep = "WHERE rk = 1 OR probability >= 0.5 OR coverage >= best" if gate else ""
    return f"""WITH {_hits(q)}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id, idx) AS rn, count(*) OVER () AS total_before_cap FROM c {keep})
    SELECT rn::INT AS rn, conv_id, idx, round(score, 6) AS score, round(probability, 6) AS probability, coverage::INT AS coverage, total_before_cap FROM t WHERE rn BETWEEN {lo} AND {hi}"""


def turn_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose idx is their turn: for a ranking, whose few hits get their place at the end."""
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", "text", F.concat_ws(" ", "role", F.coalesce("text", F.lit("")), F.lit("")).alias("doc"))


def _ranked(spark: SparkSession, d: str, q: str) -> DataFrame:
    return search.numbered(search.ranks(turn_documents(spark, d), q), table(spark, d, "conversations"))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("rn", "conv_id", "idx", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"), "coverage", "total_before_cap")


@query(_top(MULTI, True))
def recall_multi_term(spark, d):
    return _shown(_ranked(spark, d, MULTI))


@query(_top(SINGLE, False))
def recall_single_term(spark, d):
    return _shown(_ranked(spark, d, SINGLE))


@query(_top(MIXED, True))
def recall_pattern_terms(spark, d):
    return _shown(_ranked(spark, d, MIXED))


@query(_top(MULTI, True, 6, 10))
def recall_page2(spark, d):
    return _shown(search.page(_ranked(spark, d, MULTI), 2))


@query(f"WITH {ENTRIES} SELECT conv_id, idx, role FROM e WHERE regexp_matches(doc, '(?i){PATTERN}') ORDER BY conv_id, idx")
def recall_regex(spark, d):
    return search.matching(entries(spark, d), PATTERN).select("conv_id", "idx", "role")


@query(f"""WITH {ENTRIES}, p AS (SELECT conv_id, idx FROM e WHERE regexp_matches(doc, '(?i)\\w+stly\\b'))
SELECT conv_id, idx, 'pattern' AS reading FROM p ORDER BY conv_id, idx LIMIT 50""")
def recall_literal_union(spark, d):
    return search.both_readings(entries(spark, d), PATH)


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(R.STOPWORDS)) + "]"


def many_hits(parts: str) -> str:
    """Hits of every query among its session's entries; parts: CTEs e (session_id, idx, doc) and q0 (session_id, label, w: words)."""
    return rf"""WITH {parts},
q AS (SELECT session_id, label, CASE WHEN len(list_filter(w, lambda t: NOT list_contains({_STOP}, lower(t)))) > 0 THEN list_filter(w, lambda t: NOT list_contains({_STOP}, lower(t))) ELSE w END AS w FROM q0 WHERE len(w) > 0),
u AS (SELECT session_id, label, len(list_distinct(list_transform(w, lambda t: lower(t)))) > 1 AS several, unnest(w) AS term FROM q), t AS (SELECT session_id, label, several, term, count(*) AS times FROM u GROUP BY ALL),
d AS (SELECT *, len(regexp_extract_all(doc, '[\p{{L}}\p{{N}}_]+')) AS dl FROM e), s AS (SELECT session_id, count(*) AS n, avg(dl) AS avg_dl FROM d GROUP BY session_id),
p AS (SELECT d.session_id, d.idx, d.dl, k.term, ((length(lower(doc)) - length(replace(lower(doc), lower(term), ''))) / length(term))::BIGINT AS tf FROM d JOIN (SELECT DISTINCT session_id, term FROM t) k ON k.session_id = d.session_id AND contains(lower(d.doc), lower(k.term))),
f AS (SELECT session_id, term, count(*) AS df FROM p GROUP BY ALL),
h AS (SELECT p.session_id, t.label, t.several, p.idx, dl / avg_dl AS ratio, sum(times * (ln((n - df * times + 0.5e0) / (df * times + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl)))) AS score, sum(times * tf) AS tf, count(DISTINCT lower(p.term)) AS coverage
  FROM p JOIN t ON t.session_id = p.session_id AND t.term = p.term JOIN f ON f.session_id = p.session_id AND f.term = p.term JOIN s ON s.session_id = p.session_id GROUP BY p.session_id, t.label, t.several, p.idx, dl, avg_dl),
a AS (SELECT session_id, label, CASE WHEN stddev_pop(score) FILTER (score > 0) > 0 THEN 1 / stddev_pop(score) FILTER (score > 0) ELSE 1 END AS alpha, coalesce(median(score) FILTER (score > 0), 0) AS beta, max(coverage) AS best FROM h GROUP BY ALL),
k AS (SELECT h.*, best, 1 / (1 + exp(-alpha * (score - beta))) AS l, greatest(0.1e0, least(0.9e0, 0.7e0 * (0.2e0 + 0.7e0 * least(1, tf / 10)) + 0.3e0 * (0.3e0 + 0.6e0 * (1 - least(1, abs(ratio - 0.5e0) * 2))))) AS pr, row_number() OVER (PARTITION BY h.session_id, h.label ORDER BY round(score, 9) DESC, idx) AS rk FROM h JOIN a ON a.session_id = h.session_id AND a.label = h.label),
g AS (SELECT * FROM k WHERE NOT several OR rk = 1 OR l * pr / (l * pr + (1 - l) * (1 - pr)) >= 0.5 OR coverage >= best)
SELECT q.session_id, q.label, least(count(g.idx), 50)::BIGINT AS n_hits FROM q LEFT JOIN g ON g.session_id = q.session_id AND g.label = q.label GROUP BY ALL"""


@query(many_hits(r"""e AS (SELECT conv_id AS session_id, turn AS idx, concat_ws(' ', role, coalesce(text, ''), '') AS doc FROM conversations), x AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY conv_id),
q0 AS (SELECT c.conv_id AS session_id, unnest(CASE WHEN turn = a AND turn = b THEN ['first', 'last'] WHEN turn = a THEN ['first'] ELSE ['last'] END) AS label, regexp_extract_all(text, '[\p{L}\p{N}_./-]{3,}')[1:6] AS w FROM conversations c JOIN x ON x.conv_id = c.conv_id AND c.turn IN (a, b))"""))
def probe_hits(spark, d):
    """Every conversation searched by the words of its first and of its last turn, all in one job."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "text", F.concat_ws(" ", "role", F.coalesce("text", F.lit("")), F.lit("")).alias("doc"))
    per = Window.partitionBy("session_id")
    ends = turns.withColumn("a", F.min("idx").over(per)).withColumn("b", F.max("idx").over(per))
    label = F.explode(F.concat(F.when(F.col("idx") == F.col("a"), F.array(F.lit("first"))).otherwise(F.array().cast("array<string>")), F.when(F.col("idx") == F.col("b"), F.array(F.lit("last"))).otherwise(F.array().cast("array<string>"))))
    return many.hit_counts(turns, ends.select("session_id", label.alias("label"), T.query_of(F.col("text")).alias("query")).where("query <> ''"))


@query(f"WITH {_hits(MULTI)} SELECT n, round(avg_dl, 6) AS avg_dl, df0, df1, df2 FROM s")
def bm25_corpus_stats(spark, d):
    return search.corpus_stats(search.measured(turn_documents(spark, d), R.query_terms(MULTI)), R.query_terms(MULTI)).withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {_hits(MULTI)} SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, best::INT AS best FROM a")
def posterior_params(spark, d):
    terms = R.query_terms(MULTI)
    rows = search.measured(turn_documents(spark, d), terms)
    known = search.likelihood(search.scored(rows, terms, search.corpus_stats(rows, terms).first()))
    return spark.createDataFrame([(round(known["alpha"], 6), round(known["beta"], 6), known["best"])], "alpha double, beta double, best int")


@query(f"WITH {ENTRIES}, s AS (SELECT DISTINCT conv_id FROM e WHERE role = 'system') SELECT e.conv_id, e.idx, e.role FROM e WHERE conv_id IN (SELECT conv_id FROM s)")
def recall_scope_lineage(spark, d):
    rows = entries(spark, d)
    return rows.join(rows.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "idx", "role")


@query(f"WITH {ENTRIES} SELECT conv_id, idx, role FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) <= 2")
def browse_recent(spark, d):
    return windows.newest(entries(spark, d), "conv_id", "idx", 2).select("conv_id", "idx", "role")


@query(f"WITH {LOG} SELECT session_id, entry_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY session_id, entry_id) AS n FROM g WHERE type = 'message') WHERE n = 1")
def global_index(spark, d):
    return windows.global_index(log_entries(spark, d))


@query(f"""WITH {LOG}, x AS (SELECT *, max(CASE WHEN type = 'compaction' THEN seq END) OVER w AS comp, max(CASE WHEN type = 'reset_boundary' THEN seq END) OVER w AS res FROM g WINDOW w AS (PARTITION BY session_id)),
y AS (SELECT *, max(CASE WHEN seq = comp THEN first_kept END) OVER (PARTITION BY session_id) AS kept FROM x),
z AS (SELECT *, count(*) FILTER (entry_id = kept AND kept <> '') OVER (PARTITION BY session_id) AS na, min(CASE WHEN entry_id = kept AND kept <> '' THEN seq END) OVER (PARTITION BY session_id) AS anchor FROM y)
SELECT session_id, seq, entry_id, type FROM z WHERE type IN ('message', 'custom_message')
AND seq >= CASE WHEN res > coalesce(comp, -1) THEN res + 1 WHEN na = 1 AND anchor < comp THEN anchor ELSE coalesce(comp + 1, 0) END""")
def live_window(spark, d):
    return windows.live_entries(log_entries(spark, d))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(text[1:201], ' ') AND 201 - strpos(reverse(text[1:201]), ' ') > 120 THEN text[1:201 - strpos(reverse(text[1:201]), ' ')] ELSE text[1:200] END AS clipped FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text")).alias("clipped"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::INT AS n FROM documents")
def nonblank_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.nonblank_lines(F.col("text"))).alias("n"))


@query("""WITH p AS (SELECT conv_id, turn, text, strpos(lower(text), 'stly') AS hit FROM conversations),
q AS (SELECT *, greatest(hit - 60, 1) AS s, least(hit + 64, length(text) + 1) AS e FROM p WHERE hit > 0)
SELECT conv_id, turn, CASE WHEN s > 1 THEN '...' ELSE '' END || text[s:e - 1] || CASE WHEN e <= length(text) THEN '...' ELSE '' END AS snippet FROM q""")
def first_match_snippet(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text"), "stly").alias("snippet")).where("snippet is not null")


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def script_aware_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, length(text) > 0 AND length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / length(text) < 0.7e0 AS dense FROM documents")
def dense_content(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_dense(F.col("text")).alias("dense"))


@query("""WITH x AS (SELECT doc_id, text, length(text) AS c, doc_id % 900 + 1 AS t FROM documents WHERE text <> ''),
y AS (SELECT *, c / t AS raw, length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / c < 0.7e0 AS dense FROM x)
SELECT doc_id, round(CASE WHEN raw < 2.5e0 THEN CASE WHEN dense THEN 3.0e0 ELSE 4.0e0 END ELSE greatest(2.0e0, least(6.0e0, raw)) END, 6) AS cpt FROM y""")
def calibrate_cpt(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.round(T.chars_per_token(F.char_length(text), F.col("doc_id") % 900 + 1, text, text), 6).alias("cpt"))


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def usage_stats_by_session(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.sum(F.char_length("text")).alias("chars")
    )


@query(f"WITH {BLOCKS} SELECT kind, count(*) AS n, count(DISTINCT session_id) AS sessions FROM b GROUP BY kind")
def role_counts(spark, d):
    return blocks(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


SCORED = f"""WITH {BLOCKS}, s AS (SELECT *, (CASE WHEN count(*) OVER (PARTITION BY session_id) > 1 THEN floor(blk / (count(*) OVER (PARTITION BY session_id) - 1) * 12 + 0.5e0) ELSE 0 END
  + CASE kind WHEN 'user' THEN 18 WHEN 'assistant' THEN 10 WHEN 'tool_call' THEN CASE name WHEN 'edit' THEN 34 ELSE 6 END
    ELSE 8 + CASE WHEN exit_code <> 0 THEN 24 ELSE 0 END + CASE WHEN command = 'npm test' THEN 22 ELSE 0 END + CASE WHEN command LIKE 'git commit%' THEN 14 ELSE 0 END
      - CASE WHEN command = 'ls -la' AND exit_code = 0 THEN 16 ELSE 0 END END)::BIGINT AS score FROM b),
  i AS (SELECT *, score >= 34 OR name = 'edit' OR command = 'npm test' OR exit_code <> 0 AS important FROM s),
  near AS (SELECT session_id, important, last_value(CASE WHEN kind = 'user' THEN blk END IGNORE NULLS) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS u,
    last_value(CASE WHEN kind = 'assistant' THEN blk END IGNORE NULLS) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a,
    first_value(CASE WHEN kind IN ('assistant', 'bash') THEN blk END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f FROM i WINDOW w AS (PARTITION BY session_id ORDER BY blk)),
  boost AS (SELECT session_id, blk, sum(p)::BIGINT AS boost FROM (SELECT session_id, u AS blk, 10 AS p FROM near WHERE important UNION ALL SELECT session_id, a, 7 FROM near WHERE important
    UNION ALL SELECT session_id, f, 5 FROM near WHERE important) WHERE blk IS NOT NULL GROUP BY ALL),
  close AS (SELECT session_id, blk FROM (SELECT *, first_value(kind) OVER (PARTITION BY session_id ORDER BY blk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM b)
    WHERE kind = 'assistant' AND length(trim(text)) >= 120 AND coalesce(nx = 'user', true))"""


@query(f"{SCORED} SELECT session_id, blk, kind, score FROM s")
def block_scores(spark, d):
    return B.scores(blocks(spark, d)).select("session_id", "blk", "kind", "score")


@query(f"{SCORED} SELECT * FROM boost")
def adjacency_boost(spark, d):
    return B.adjacency(B.scores(blocks(spark, d)))


@query(f"{SCORED} SELECT * FROM close")
def segment_closing(spark, d):
    return B.closing(blocks(spark, d))


@query(f"{SCORED} SELECT s.session_id, s.blk, s.score + coalesce(boost, 0) + CASE WHEN c.blk IS NULL THEN 0 ELSE 14 END AS score FROM s LEFT JOIN boost x ON x.session_id = s.session_id AND x.blk = s.blk LEFT JOIN close c ON c.session_id = s.session_id AND c.blk = s.blk")
def ranked_blocks(spark, d):
    return B.ranked(blocks(spark, d)).select("session_id", "blk", "score")


@query(f"WITH {BLOCKS} SELECT session_id, path, min(blk) AS first_blk, string_agg(blk || ':' || name, ',' ORDER BY blk) AS entries FROM b WHERE path IS NOT NULL GROUP BY ALL")
def touched_files(spark, d):
    return B.touched(blocks(spark, d))


@query(f"WITH {BLOCKS} SELECT session_id, path, CASE WHEN bool_or(name = 'edit') THEN 'modified' ELSE 'read' END AS activity FROM b WHERE kind = 'tool_call' GROUP BY ALL")
def file_activity(spark, d):
    return B.file_activity(blocks(spark, d))


@query(f"WITH {BLOCKS} SELECT session_id, CASE WHEN count(DISTINCT string_split(path, '/')[4]) = 1 THEN '/repo/src/' || min(string_split(path, '/')[4]) || '/' ELSE '/repo/src/' END AS dir FROM b WHERE path IS NOT NULL GROUP BY session_id HAVING count(*) >= 2")
def common_directory(spark, d):
    return B.common_directory(blocks(spark, d))


@query(f"""WITH {BLOCKS}, x AS (SELECT *, first_value(CASE WHEN kind IN ('tool_call', 'user') THEN blk END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
first_value(CASE WHEN kind = 'bash' THEN blk END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS result_blk FROM b WINDOW w AS (PARTITION BY session_id ORDER BY blk))
SELECT session_id, blk, result_blk FROM x WHERE kind = 'tool_call' AND result_blk IS NOT NULL AND (stop IS NULL OR result_blk < stop)""")
def call_result_pairs(spark, d):
    return B.call_results(blocks(spark, d), F.col("kind") == "bash")


@query(f"""WITH {BLOCKS}, h AS (SELECT session_id, blk, CASE WHEN kind IN ('user', 'bash') THEN '[user]' ELSE '[assistant]' END AS header FROM b),
n AS (SELECT *, CASE WHEN lag(header) OVER w = header THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY session_id ORDER BY blk)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY blk)::BIGINT AS section FROM n)
SELECT session_id, section, min(header) AS header, min(blk) AS first_blk, count(*) AS n_blocks FROM r GROUP BY session_id, section""")
def section_islands(spark, d):
    return B.sections(blocks(spark, d))


@query(f"""WITH {BLOCKS}, c AS (SELECT *, regexp_extract(path, '^(.*)/', 1) AS dir FROM b WHERE kind = 'tool_call'),
n AS (SELECT *, coalesce(lag(name) OVER w <> name OR lag(dir) OVER w <> dir OR lag(blk) OVER w <> blk - 1, true)::INT AS new FROM c WINDOW w AS (PARTITION BY session_id ORDER BY blk)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY blk) AS run FROM n)
SELECT session_id, min(blk) AS first_blk, min(name) AS name, min(dir) AS dir, count(*) AS times FROM r GROUP BY session_id, run""")
def repeat_collapse(spark, d):
    return B.repeats(blocks(spark, d))


@query(f"""WITH {BLOCKS}, t AS (SELECT *, sum((kind = 'user')::INT) OVER (PARTITION BY session_id ORDER BY blk)::BIGINT AS turn FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY session_id, turn) AS n, row_number() OVER (PARTITION BY session_id, turn ORDER BY blk DESC) AS back FROM t WHERE kind = 'tool_call')
SELECT session_id, turn, blk, greatest(0, n - 2) AS omitted FROM c WHERE back <= 2""")
def tool_cap_tail(spark, d):
    return B.last_calls(blocks(spark, d), 2)


@query(f"""WITH {MESSAGES}, {PLACED}, q AS (SELECT session_id, max(n) AS n, count(*) FILTER (role = 'user') AS users, min(i) FILTER (role = 'user') AS fu, min(i) FILTER (role = 'user' AND back = 2) AS pos FROM p GROUP BY session_id)
SELECT session_id, CASE WHEN n <= 2 THEN 'too_few' WHEN pos > 0 THEN 'cut' ELSE 'compact_all' END AS outcome,
CASE WHEN n <= 2 THEN NULL WHEN pos > 0 THEN pos ELSE n END AS cut, CASE WHEN n <= 2 THEN NULL WHEN pos > 0 THEN 2 ELSE 0 END::BIGINT AS kept_turns FROM q""")
def own_cut_keep_n(spark, d):
    return windows.cuts(messages(spark, d), 2)


@query(f"""WITH {MESSAGES}, {PLACED}, q AS (SELECT session_id, max(back) FILTER (suffix <= 600) AS grown, max(CASE WHEN back = 1 AND suffix <= 200 THEN 1 END) AS small FROM p WHERE role = 'user' AND n > 2 AND i > 0 GROUP BY session_id)
SELECT m.session_id, CASE WHEN small = 1 THEN coalesce(grown, 1) ELSE 1 END::BIGINT AS keep FROM (SELECT DISTINCT session_id FROM m) m LEFT JOIN q ON q.session_id = m.session_id""")
def smart_keep(spark, d):
    return windows.smart_keep(messages(spark, d), 200, 600)


@query(f"""WITH {MESSAGES}, {PLACED}, x AS (SELECT *, max(CASE WHEN suffix >= 300 THEN i END) OVER (PARTITION BY session_id) AS crossed FROM p)
SELECT session_id, coalesce(min(i) FILTER (crossed IS NOT NULL AND i >= greatest(crossed, 1)), -1) AS cut FROM x GROUP BY session_id""")
def tail_budget_cut(spark, d):
    return windows.budget_cuts(messages(spark, d), 300)


@query(f"""WITH {BLOCKS}, o AS (SELECT session_id, blk AS seq, tokens, sum(tokens) OVER w AS spent, row_number() OVER w AS rn FROM b WHERE kind = 'bash' WINDOW w AS (PARTITION BY session_id ORDER BY blk DESC)),
k AS (SELECT *, min(CASE WHEN tokens > 15 AND spent > 2000 THEN rn END) OVER (PARTITION BY session_id) AS brk FROM o)
SELECT session_id, seq, tokens, brk IS NULL OR rn < brk OR tokens <= 15 AS kept FROM k""")
def retained_output_projection(spark, d):
    return windows.retained_outputs(blocks(spark, d).where("kind = 'bash'").select("session_id", F.col("blk").alias("seq"), "tokens"), 2000)


@query("SELECT event_id, (event_id * 7 % 9000 - event_id * 3 % 5000) > greatest(512, floor((event_id * 3 % 5000) * 0.25e0 + 0.5e0)) OR (event_id * 7 % 9000 - event_id * 3 % 5000) > 4096 AS trips FROM events")
def growth_guard(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", windows.growth_trips(e * 3 % 5000, e * 7 % 9000).alias("trips"))


@query("""WITH x AS (SELECT event_id, event_id * 37 % 300000 AS w, 16000 AS r, event_id * 13 % 60000 AS c, event_id * 11 % 40000 AS b, event_id * 29 % 200000 AS f FROM events)
SELECT event_id, CASE WHEN b < c AND ((w > 0 AND f > greatest(0, w - r)) OR (c >= CASE WHEN w > 0 THEN floor(w / 8) ELSE 34000 END
AND greatest(0, f - b) >= CASE WHEN w > 0 THEN greatest(1, least(24000, floor(w * 24000 / 272000))) ELSE 24000 END)) THEN 'rebase' ELSE 'append' END AS mode FROM x""")
def append_decision(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", windows.append_mode(e * 37 % 300000, F.lit(16000), e * 13 % 60000, e * 11 % 40000, e * 29 % 200000).alias("mode"))


SEGMENTS = f"""g AS (SELECT conv_id AS session_id, row_number() OVER w + CASE WHEN conv_id % 5 = 0 AND turn > 2 THEN 1 ELSE 0 END AS sequence, 'e' || turn AS first_covered,
CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'e' || (turn + CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END) END AS first_kept, text AS summary, turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""WITH {SEGMENTS}, k AS (SELECT *, lag(sequence) OVER w AS b, lag(first_kept) OVER w AS kb FROM g WINDOW w AS (PARTITION BY session_id ORDER BY sequence))
SELECT session_id, bool_and(CASE WHEN b IS NULL THEN sequence = 1 ELSE sequence = b + 1 AND (kb = '' OR kb = first_covered) END) AS valid, count(*) AS n, sum({_tokens("summary")})::BIGINT AS tokens FROM k GROUP BY session_id""")
def chain_validity(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("rn", F.row_number().over(w))
    return windows.chains(rows.selectExpr(
        "conv_id AS session_id", "rn + CASE WHEN conv_id % 5 = 0 AND turn > 2 THEN 1 ELSE 0 END AS sequence", "concat('e', turn) AS first_covered",
        "CASE WHEN conv_id % 3 = 0 THEN '' ELSE concat('e', turn + CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END) END AS first_kept", "text AS summary",
    ))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def history_cap(spark, d):
    return windows.newest(table(spark, d, "events"), "user_id", "event_id", 50).select("user_id", "event_id")


@query(f"""WITH {ENTRIES}, l AS (SELECT conv_id, list(text ORDER BY idx) FILTER (role = 'user') AS p, list(text ORDER BY idx) FILTER (role <> 'user') AS f FROM e GROUP BY conv_id),
u AS (SELECT conv_id, list_concat(coalesce(p, []), list_filter(coalesce(f, []), lambda x: NOT list_contains(coalesce(p, []), x))) AS a FROM l)
SELECT conv_id, array_to_string(CASE WHEN len(a) <= 4 THEN a ELSE list_concat(a[1:1], a[len(a) - 2:len(a)]) END, '|') AS merged FROM u""")
def union_distinct_merge(spark, d):
    rows = entries(spark, d).withColumn("t", F.col("text")).groupBy("conv_id")
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("idx", "t")))), lambda x: x["t"])
    lists = rows.agg(side(F.col("role") == "user").alias("p"), side(F.col("role") != "user").alias("f"))
    return lists.select("conv_id", F.array_join(windows.merged_lines(F.col("p"), F.col("f"), 4, True), "|").alias("merged"))


GOAL = f"""WITH g AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 5) AS lines FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, list_transform(lines, lambda t: CASE WHEN length(t) <= 200 THEN t WHEN contains(t[1:201], ' ') AND 201 - strpos(reverse(t[1:201]), ' ') > 120 THEN t[1:201 - strpos(reverse(t[1:201]), ' ')] ELSE t[1:200] END) AS lines,
  min(turn) OVER (PARTITION BY conv_id) AS first, regexp_matches(text[1:200], '(?i)\\b(fix|implement|add|create|build|refactor|debug|investigate|update|remove|delete|migrate|deploy|test|write|set up)\\b') AS task,
  regexp_matches(text[1:200], '(?i)\\b(instead|actually|pivot)\\b') AS scope FROM g WHERE len(lines) > 0),
l AS (SELECT conv_id, arg_max(CASE WHEN scope THEN lines[1:3] ELSE lines[1:2] END, turn) AS more FROM k WHERE turn > first AND (scope OR (task AND length(lines[1]) > 15)) GROUP BY conv_id)
SELECT f.conv_id AS session_id, array_to_string(list_concat(f.lines[1:6], CASE WHEN l.more IS NULL THEN [] ELSE list_concat(['[Scope change]'], l.more) END)[1:8], '|') AS goals FROM k f LEFT JOIN l ON l.conv_id = f.conv_id WHERE f.turn = f.first"""


@query(GOAL)
def session_goals(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("blk"), F.col("role").alias("kind"), "text")
    return facts.goals(rows).select("session_id", F.array_join("goals", "|").alias("goals"))
