"""Queries on text functions and facts: texts of the tables, marked by rule where a function needs more than prose, and SQL that finds the results its own way."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import brief as W
from ..functions import relevance as R
from ..functions import text as T
from ..operators import facts, merging, summary, terms
from ..sources import messages as M
from ..sources.sessions import table
from .catalog import query

ESC = "\x1b"


@query("SELECT doc_id, text || chr(10) || 'end' AS clean FROM documents")
def sanitized(spark, d):
    dirty = F.concat(F.lit(f"{ESC}[31m{ESC}]0;title\x07"), "text", F.lit(f"{ESC}[0;1m\r\n\x00e\x08nd\x1f{ESC}[K"))
    return table(spark, d, "documents").select("doc_id", T.sanitize(dirty).alias("clean"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 40 THEN t WHEN contains(t[1:41], ' ') AND 41 - strpos(reverse(t[1:41]), ' ') > 24 THEN t[1:41 - strpos(reverse(t[1:41]), ' ')] ELSE t[1:40] END AS line FROM l""")
def first_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_line(F.col("text"), 40).alias("line"))


#: A pattern or plain text about each item's first two words.
PATTERN = "CASE item_id % 8 WHEN 0 THEN a || '.ts' WHEN 1 THEN a || '|' || b WHEN 2 THEN '[' || a WHEN 3 THEN '(' || a || '+)+$' WHEN 4 THEN '(' || a || ')+' || b || '*' WHEN 5 THEN a || '{2,}' WHEN 6 THEN '((' || a || '|' || b || '+)*)*' ELSE a || ' ' || b END"
ITEMS = r"w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), i AS (SELECT item_id, w[1] AS a, w[2] AS b FROM w WHERE len(w) > 1)"


@query(rf"""WITH {ITEMS}, p AS (SELECT item_id, a, b, {PATTERN} AS pattern FROM i)
SELECT item_id, pattern, regexp_matches(pattern, '[|*+?{{}}()\[\]\\^$]') AS is_pattern, CASE WHEN item_id % 8 IN (2, 3, 6) THEN regexp_replace(pattern, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') ELSE pattern END AS safe FROM p""")
def query_patterns(spark, d):
    """What doesn't compile, or nests quantifiers, is escaped; the parser of patterns is Python's, so it runs on Arrow batches."""

    @F.pandas_udf("is_pattern boolean, safe string")
    def told(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"is_pattern": patterns.map(R.looks_like_regex), "safe": patterns.map(R.safe_pattern)})

    words = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) > 1")
    asked = words.selectExpr("item_id", "w[0] AS a", "w[1] AS b").select("item_id", F.expr(PATTERN).alias("pattern"))
    return asked.select("item_id", "pattern", told("pattern").alias("t")).select("item_id", "pattern", "t.*")


@query(r"""WITH q AS (SELECT item_id, string_split_regex(lower(text), '\s+') AS w FROM benchmark), t AS (SELECT item_id, unnest(list_distinct(list_filter(w, lambda x: x <> ''))) AS t, len(list_distinct(list_filter(w, lambda x: x <> ''))) AS n FROM q),
d AS (SELECT doc_id, lower(text) AS text FROM documents), v AS (SELECT DISTINCT t FROM t), m AS (SELECT doc_id, v.t FROM d JOIN v ON contains(d.text, v.t))
SELECT t.item_id, m.doc_id FROM t JOIN m ON m.t = t.t GROUP BY t.item_id, t.n, m.doc_id HAVING count(*) = t.n""")
def documents_with_terms(spark, d):
    """Every item against every document, all terms."""
    return terms.all_terms(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(r"""WITH t AS (SELECT doc_id, replace(replace(text, ' ', ' ' || chr(9) || ' '), chr(10), ' ' || chr(13) || chr(10) || chr(10) || chr(10)) || chr(13) AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\t\v\f ]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^[\s\v]+|[\s\v]+$', '', 'g') AS flat FROM t""")
def squeezed_texts(spark, d):
    dirty = F.concat(F.replace(F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\n"), F.lit(" \r\n\n\n")), F.lit("\r"))
    return table(spark, d, "documents").select("doc_id", W.squeezed(dirty).alias("flat"))


_FREE = "[" + ", ".join(f"'{w}'" for w in W.FREE_WORDS) + "]"
_WORD = r"[\p{L}\p{N}_]+(?:[''.’][\p{L}\p{N}_]+)*"


@query(rf"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\t\v\f ]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^[\s\v]+|[\s\v]+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, string_split_regex(t, '{_WORD}') AS g FROM f),
c AS (SELECT *, list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '[\p{{L}}\p{{N}}]') AND NOT list_contains({_FREE}, lower(x)) THEN i END), lambda i: i IS NOT NULL) AS ix FROM p)
SELECT doc_id, CASE WHEN len(ix) <= 20 THEN t ELSE regexp_replace(array_to_string(list_transform(range(1, ix[21]), lambda i: g[i] || w[i]), '') || g[ix[21]], '[\s\v]+$', '') || '...(truncated)' END AS first_words,
CASE WHEN len(ix) <= 20 THEN t ELSE array_to_string(list_transform(range(1, ix[12] + 1), lambda i: g[i] || w[i]), '') || chr(10) || '...(middle truncated)...' || chr(10) || array_to_string(list_transform(range(ix[len(ix) - 7], len(w) + 1), lambda i: w[i] || g[i + 1]), '') END AS ends FROM c""")
def word_limits(spark, d):
    return table(spark, d, "documents").select("doc_id", W.first_words(F.col("text"), 20).alias("first_words"), W.ends_of_words(F.col("text"), 12, 8).alias("ends"))


#: Three of a turn's own words, as names of programs and files.
THREE = "w AS (SELECT conv_id, turn, role, text, regexp_extract_all(text, '[a-zA-Z]{3,}') AS w FROM conversations), t AS (SELECT *, lower(w[1]) AS a, lower(w[2]) AS b, lower(w[3]) AS c FROM w WHERE len(w) > 2)"


def three_words(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), F.lit(0)).alias("w")).where("size(w) > 2")
    return rows.selectExpr("conv_id", "turn", "role", "text", "lower(w[0]) AS a", "lower(w[1]) AS b", "lower(w[2]) AS c")


SCRIPT = "CASE turn % 4 WHEN 0 THEN concat('set -e\ncd /', a, ' && x', b, ' ', c, ' | sort | tail -5\n') WHEN 1 THEN concat('cat > ', a, ' <<EOF\n', b, '\nEOF\nrun', c) WHEN 2 THEN concat('cd /', a, '\nexport ', b, '=1\n# ', c) ELSE concat('x', a, ' - <<PY\nimport ', b, '\n', c, '(1)\nPY\nls ', b) END"


@query(rf"""WITH {THREE} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x' || b || ' ' || c WHEN 1 THEN 'cat > ' || a || ' <<EOF; run' || c WHEN 2 THEN 'cd /' || a ELSE 'x' || a || ' - <<PY ' || c || '(1); ls ' || b END AS r FROM t""")
def short_scripts(spark, d):
    return three_words(spark, d).select("conv_id", "turn", W.short_commands(F.expr(SCRIPT)).alias("r"))


@query(rf"WITH {THREE} SELECT conv_id, turn, turn % 4 = 2 AS r FROM t")
def scaffold_scripts(spark, d):
    return three_words(spark, d).select("conv_id", "turn", W.only_scaffolding(F.expr(SCRIPT)).alias("r"))


@query(rf"""WITH {THREE}, n AS (SELECT *, regexp_matches(text, '^\s*(?i:hmm|wait|actually|oh|okay|ok|well|so)[,.!\s-]') AS talks FROM t)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' [skill: ' || a || '] ' || c ELSE c || ' [skill: ' || a || ']' END AS r FROM n WHERE NOT talks""")
def plain_speech(spark, d):
    said = F.expr("""CASE turn % 3 WHEN 0 THEN concat('Okay, hmm - ', text) WHEN 1 THEN concat('Well. ', text, ' <skill name="', a, '" x>', b, '\n</skill> ', c) ELSE concat('so ', c, ' <skill name="', a, '">', text) END""")
    rows = three_words(spark, d).where(~F.col("text").rlike(r"^\s*(?i:hmm|wait|actually|oh|okay|ok|well|so)[,.!\s-]"))
    return rows.select("conv_id", "turn", W.collapsed_skills(W.without_self_talk(said)).alias("r"))


#: Each line of each text is cut step by step: at the last blank that the room holds, or, where that lies in the first half, a place before its end.
@query(r"""WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(string_split(text, chr(10)), [NULL]::VARCHAR[]) AS l FROM documents),
l AS (SELECT doc_id, k, unnest(list_transform(l, lambda x: '- ' || trim(regexp_replace(x, '[\s\v]+', ' ', 'g'), ' '))) AS rest, generate_subscripts(l, 1) AS n FROM t),
w AS (SELECT doc_id, k, n, 0 AS i, NULL::VARCHAR AS piece, rest, '' AS lead FROM l UNION ALL
SELECT doc_id, k, n, i + 1, CASE WHEN length(rest) <= room THEN lead || rest WHEN cut >= room // 2 THEN lead || rtrim(substr(rest, 1, cut), ' ') ELSE lead || substr(rest, 1, room - 1) || chr(92) END,
CASE WHEN length(rest) <= room THEN NULL WHEN cut >= room // 2 THEN ltrim(substr(rest, cut + 1), ' ') ELSE substr(rest, room) END, '  '
FROM (SELECT *, 120 - length(lead) AS room, length(regexp_extract(substr(rest, 1, 121 - length(lead)), '(?s)^(.*) ', 1)) AS cut FROM w WHERE rest IS NOT NULL)),
d AS (SELECT any_value(doc_id) AS doc_id, string_agg(piece, chr(10) ORDER BY n, i) AS lines, bool_and(length(piece) <= 120) AS fits FROM w GROUP BY k)
SELECT doc_id, lines, replace(replace(lines, chr(92) || chr(10) || '  ', ''), chr(10) || '  ', ' ') AS back, fits FROM d""")
def wrapped_lines(spark, d):
    """Whole texts, each line a bullet, wrapped, no line over the limit, and read back."""
    told = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), F.trim(F.regexp_replace(x, r"\s+", " "))))
    rows = table(spark, d, "documents").select("doc_id", W.wrapped(F.array_join(told, "\n")).alias("lines"))
    return rows.select("doc_id", "lines", F.array_join(merging.joined_lines(F.col("lines")), "\n").alias("back"), F.forall(F.split("lines", "\n"), lambda x: F.char_length(x) <= W.LINE_MOST).alias("fits"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:4], lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: replace(x, ',', chr(92) || ',')), ', ') AS escaped, l AS paths, CASE WHEN len(l) > 0 THEN array_to_string(string_split('/' || replace(l[1], ' ', '/'), '/')[-3:], '/') END AS short FROM l""")
def path_lists(spark, d):
    """Lines as paths, commas and all: listed, and read back from the list."""
    lines = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 4), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", lines.alias("p")).withColumn("escaped", F.array_join(F.transform("p", T.escape_commas), ", "))
    return rows.select("doc_id", "escaped", T.split_escaped(F.col("escaped")).alias("paths"), F.when(F.size("p") > 0, T.short_path(F.concat(F.lit("/"), F.replace(F.get("p", F.lit(0)), F.lit(" "), F.lit("/"))))).alias("short"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1000 THEN n_chars::VARCHAR ELSE CASE WHEN n_chars % 1000 = 250 THEN n_chars // 1000 || '.3k' ELSE printf('%.1fk', n_chars / 1000) END END AS shown,
text[1:list_max(list_filter(range(0, 51), lambda k: strlen(text[1:k]) <= 50))] AS cut, greatest(3, n_chars % 10) AS at_least, 7::BIGINT AS missing FROM documents WHERE text IS NOT NULL""")
def numbers_and_bytes(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.format_tokens(n).alias("shown"), T.clip_bytes(F.col("text"), 50).alias("cut"), T.positive_or((n % 10).cast("double"), 3, 7).alias("at_least"), T.positive_or(F.lit(float("nan")), 3, 7).alias("missing"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l[1:2], lambda x: '- ' || x), '|') AS goal, array_to_string(list_transform(l[3:4], lambda x: '- ' || x), '|') AS commits, '' AS blockers FROM l WHERE len(l) > 3""")
def summary_sections(spark, d):
    """Sections of lines of the texts, wrapped as a summary is, and read back."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", lines.alias("l")).where("size(l) > 3")
    part = lambda title, lo: F.concat(F.lit(f"[{summary.TITLES[title]}]\n"), F.array_join(F.transform(F.slice("l", lo, 2), lambda x: F.concat(F.lit("- "), x)), "\n"))
    text = W.wrapped(F.concat(part("goals", 1), F.lit("\n\n"), part("commits", 3), F.lit(summary.RULE + "[user]\n"), F.element_at("l", -1), F.lit(summary.RULE + summary.NOTE)))
    read = rows.select("doc_id", summary.without_note(text).alias("s"))
    return read.select("doc_id", *[F.array_join(merging.bullets(merging.section(F.col("s"), summary.TITLES[t])), "|").alias(n) for t, n in (("goals", "goal"), ("commits", "commits"), ("blockers", "blockers"))])


@query(rf"""WITH {THREE} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ['Fix the ' || a || ' of ' || b, 'Add a test for ' || c] WHEN 1 THEN ['Deploy ' || a || ' now'] WHEN 2 THEN [] ELSE ['[skill: ' || a || ']', 'Update ' || c || ' docs'] END AS r FROM t""")
def goal_candidates(spark, d):
    said = F.expr(r"""CASE turn % 4 WHEN 0 THEN concat('Fix the ', a, ' of ', b, '\nok\n\n- Add a test for ', c, '\n/etc/', a) WHEN 1 THEN concat('https://', b, '.example/x\nDeploy ', a, ' now\nFor each issue:\nRead ', c)
      WHEN 2 THEN concat('[', a, '] output\nDo NOT implement ', b, ' yet\nRefactor ', c) ELSE concat('- <skill name="', a, '">\n', b, ' and more\n</skill>\n* Update ', c, ' docs\n<skill name="', a, '">\nbody\n</skill>') END""")
    return three_words(spark, d).select("conv_id", "turn", facts.goal_lines(said).alias("r"))


#: A log of each conversation: turns say what facts are made of, with words and hashes of their own text.
LOGGED = r"""CASE WHEN turn % 6 = 0 THEN named_struct('role', 'user', 'content', concat('Thanks\nplease use ', a, ' for ', b, '\nDo you prefer ', c, '?')) WHEN turn % 6 = 1 THEN named_struct('role', 'assistant', 'content', concat('The ', a, ' build is still failing on ', b, '\n- It failed again with ', c))
  WHEN turn % 6 = 2 THEN named_struct('role', 'user', 'content', concat('<system-reminder>never push ', a, '</system-reminder>', CASE WHEN conv_id % 2 = 0 THEN '' ELSE concat(' Look at ', b) END)) WHEN turn % 6 = 3 THEN named_struct('role', 'user', 'content', 'Continue from where you left off.')
  ELSE named_struct('role', 'assistant', 'content', 'Nothing to add') END"""
SHELL = r"""named_struct('role', 'bashExecution', 'command', concat('cd /', a, ' && git commit -am "', b, ' \\"', c, '\\""\ncat > x <<EOF\ngit commit -m no\nEOF'), 'output', concat('[main ', substring(md5(text), 1, 8), '] ', b), 'exitCode', 0)"""
BLOCK_PLACES = f"{THREE}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS blk FROM t)"


def logged_blocks(spark, d):
    """Blocks parsed from messages of each conversation's turns."""
    raw = F.expr(f"CASE WHEN turn % 6 = 5 THEN to_json({SHELL}) ELSE to_json({LOGGED}) END")
    rows = three_words(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), raw.alias("raw"))
    return M.as_blocks(rows.withColumn("message", F.try_parse_json("raw")))


@query(f"""WITH {BLOCK_PLACES}, p AS (SELECT conv_id, blk, CASE turn % 6 WHEN 0 THEN 'please use ' || a || ' for ' || b WHEN 2 THEN '<system-reminder>never push ' || a || '</system-reminder>' || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' Look at ' || b END END AS line FROM n),
o AS (SELECT conv_id AS session_id, arg_min(line, blk) AS line, min(blk) AS blk FROM p WHERE line IS NOT NULL GROUP BY conv_id, lower(line)) SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY blk)::INT AS nth FROM o QUALIFY nth <= 10""")
def preferences(spark, d):
    return facts.preferences(logged_blocks(spark, d))


@query(f"""WITH {BLOCK_PLACES}, l AS (SELECT conv_id AS session_id, blk, turn, row_number() OVER (PARTITION BY conv_id ORDER BY blk DESC) AS back, 'The ' || a || ' build is still failing on ' || b AS line FROM n),
o AS (SELECT session_id, line, min(blk) AS blk FROM l WHERE back <= 20 AND turn % 6 = 1 GROUP BY ALL) SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY blk)::INT AS nth FROM o QUALIFY nth <= 5""")
def blockers(spark, d):
    return facts.blockers(logged_blocks(spark, d))


@query(f"""WITH {BLOCK_PLACES} SELECT conv_id AS session_id, blk, CASE turn % 6 WHEN 1 THEN 'assistant' WHEN 4 THEN 'assistant' WHEN 5 THEN 'bash' ELSE 'user' END AS kind,
CASE turn % 6 WHEN 0 THEN 'Thanks' || chr(10) || 'please use ' || a || ' for ' || b || chr(10) || 'Do you prefer ' || c || '?' WHEN 1 THEN 'The ' || a || ' build is still failing on ' || b || chr(10) || '- It failed again with ' || c WHEN 2 THEN 'Look at ' || b WHEN 4 THEN 'Nothing to add' END AS text
FROM n WHERE turn % 6 <> 3 AND (turn % 6 <> 2 OR conv_id % 2 = 1)""")
def without_noise(spark, d):
    return facts.without_noise(logged_blocks(spark, d)).select("session_id", "blk", "kind", "text")


@query(f"""WITH {BLOCK_PLACES} SELECT conv_id AS session_id, blk, md5(text)[1:8] AS hash, b || ' "' || c || '"' AS message FROM n WHERE turn % 6 = 5""")
def commits(spark, d):
    return facts.commits(logged_blocks(spark, d))
