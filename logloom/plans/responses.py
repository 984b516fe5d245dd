"""Queries on responses: one request of each conversation or session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import responses
from ..sources.sessions import table
from .catalog import BLOCKS, blocks, query


@query("""WITH r AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Scope: all' ELSE '' END AS header, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 700 + conv_id % 5 * 900 END AS most FROM conversations),
s AS (SELECT r.*, turn, text, row_number() OVER w AS nth, count(*) OVER (PARTITION BY r.conv_id) AS n FROM conversations c JOIN r ON r.conv_id = c.conv_id WINDOW w AS (PARTITION BY r.conv_id ORDER BY turn)),
x AS (SELECT *, floor(greatest(greatest(most - length(header), 0) - 200 * n, 0) / n)::INT AS share FROM s), k AS (SELECT *, most = 0 OR length(text) <= share AS whole FROM x),
g AS (SELECT conv_id, any_value(header) AS header, any_value(most) AS most, string_agg(CASE WHEN whole THEN text ELSE text[1:share] END, chr(10) || chr(10) ORDER BY turn) FILTER (CASE WHEN whole THEN text <> '' ELSE share > 0 END) AS body,
  string_agg(CASE WHEN turn % 2 = 0 THEN '#' || turn ELSE 'entry ' || nth END, ', ' ORDER BY turn) FILTER (NOT whole) AS cut, count(*) FILTER (NOT whole) AS n_cut FROM k GROUP BY conv_id)
SELECT conv_id AS request_id, concat_ws(chr(10) || chr(10), nullif(header, ''), body) || CASE WHEN n_cut > 0 THEN chr(10) || chr(10) || '--- recall response capped at ' || most || ' characters; omitted entry' || CASE WHEN n_cut = 1 THEN '' ELSE 's' END || ': ' || cut || ' ---' ELSE '' END AS response FROM g""")
def capped_responses(spark, d):
    """All turns of each conversation asked for at once, within budgets that differ."""
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id").distinct().selectExpr("conv_id AS request_id", "CASE WHEN conv_id % 3 = 0 THEN 'Scope: all' END AS header", "CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 700 + conv_id % 5 * 900 END AS most")
    return responses.capped(asked, turns.selectExpr("conv_id AS request_id", "turn AS at", "CASE WHEN turn % 2 = 0 THEN concat('#', turn) END AS label", "text"))


@query("""WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE contains(lower(text), 'th') OR contains(lower(text), 'en')),
r AS (SELECT c.conv_id, c.conv_id % 3 + 1 AS page, CASE WHEN c.conv_id % 2 = 0 THEN 'all' ELSE 'lineage' END AS scope, CASE WHEN c.conv_id % 5 = 0 THEN 'file' ELSE 'hybrid' END AS mode, count(h.rn) AS total, least(count(h.rn), 6) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT *, ceil(n / 2)::BIGINT AS pages, CASE WHEN scope = 'all' THEN ' (scope: all)' ELSE '' END || CASE WHEN total > n THEN ' — showing ' || n || ' of ' || total || ' matches, refine your query for more precise results' ELSE '' END AS note, CASE WHEN mode = 'file' THEN ' with mode:''file''' ELSE '' END AS hint FROM r),
b AS (SELECT p.conv_id, string_agg('#' || turn || ' [' || role || '] ' || text[1:30], chr(10) || chr(10) ORDER BY h.rn) AS body, bool_or(length(text) > 30) AS clipped FROM p JOIN h ON h.conv_id = p.conv_id AND h.rn <= 6 AND h.rn BETWEEN (page - 1) * 2 + 1 AND page * 2 GROUP BY p.conv_id)
SELECT p.conv_id AS request_id, CASE WHEN n = 0 THEN 'No matches for "th|en" in session history.' WHEN page > pages THEN 'Page ' || page || ' is outside the available range 1-' || pages || ' (' || n || ' matches' || note || '). Use a page between 1 and ' || pages || hint || CASE WHEN total > n THEN '.' ELSE ', or refine your query.' END
ELSE CASE WHEN pages > 1 THEN 'Page ' || page || '/' || pages || ' (' || n || ' total matches' || note || ')' ELSE n || ' matches' || note END || ' for "th|en":' || chr(10) || chr(10) || body || CASE WHEN total > n OR clipped THEN chr(10) || chr(10) || '--- Use #N for full entry text ---' ELSE '' END
  || CASE WHEN page < pages THEN chr(10) || '--- Use page:' || (page + 1) || CASE WHEN scope = 'all' THEN ' with scope:''all''' ELSE '' END || hint || ' for more results ---' ELSE '' END END AS response FROM p LEFT JOIN b ON b.conv_id = p.conv_id""")
def search_pages(spark, d):
    """A page of each conversation's hits, two a page and at most six: some pages lie beyond the last one."""
    turns = table(spark, d, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    found = turns.where(F.lower("text").rlike("th|en")).withColumn("rn", place)
    shown = F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit(" ["), "role", F.lit("] "), F.substring("text", 1, 30))
    totals = found.groupBy("conv_id").agg(F.count("*").alias("total"))
    asked = turns.select("conv_id").distinct().join(totals, "conv_id", "left").selectExpr(
        "conv_id AS request_id", "'th|en' AS query", "conv_id % 3 + 1 AS page", "CASE WHEN conv_id % 2 = 0 THEN 'all' ELSE 'lineage' END AS scope", "CASE WHEN conv_id % 5 = 0 THEN 'file' ELSE 'hybrid' END AS mode", "coalesce(total, 0) AS total"
    )
    return responses.pages(asked, found.where("rn <= 6").select(F.col("conv_id").alias("request_id"), "rn", shown.alias("shown"), (F.char_length("text") > 30).alias("clipped")), 2)


@query(f"""WITH {BLOCKS}, f AS (SELECT session_id, path, min(blk) AS first_blk, string_agg('#' || blk || ' (' || name || ')', ', ' ORDER BY blk) AS refs FROM b WHERE path IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_blk, path) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM f),
r AS (SELECT u.session_id, u.session_id % 9 + 1 AS page, coalesce(max(k.n), 0) AS n, ceil(coalesce(max(k.n), 0) / 5)::BIGINT AS pages FROM (SELECT DISTINCT session_id FROM b) u LEFT JOIN k ON k.session_id = u.session_id GROUP BY u.session_id),
x AS (SELECT r.session_id, string_agg('  ' || CASE WHEN starts_with(path, '/repo/src/m1/') THEN '.' || substr(path, 13) ELSE '.../' || array_to_string(string_split(path, '/')[-3:], '/') END || '    ' || refs, chr(10) ORDER BY rn) AS body FROM r JOIN k ON k.session_id = r.session_id AND rn BETWEEN (page - 1) * 5 + 1 AND page * 5 GROUP BY r.session_id)
SELECT r.session_id AS request_id, CASE WHEN n = 0 THEN 'No file operations found in session history.' WHEN page > pages THEN 'Page ' || page || ' is outside the available range 1-' || pages || ' (' || n || ' total files). Use page:N with N between 1 and ' || pages || '.'
ELSE CASE WHEN pages > 1 THEN 'Page ' || page || '/' || pages || ' (' || n || ' total files)' ELSE n || ' files touched' END || ':' || chr(10) || chr(10) || body || CASE WHEN page < pages THEN chr(10) || chr(10) || '--- Use page:' || (page + 1) || ' for more results ---' ELSE '' END END AS response FROM r LEFT JOIN x ON x.session_id = r.session_id""")
def touched_pages(spark, d):
    rows = blocks(spark, d)
    asked = rows.select("session_id").distinct().selectExpr("session_id AS request_id", "session_id", "session_id % 9 + 1 AS page")
    return responses.touched_pages(asked, rows, "/repo/src/m1")
