"""Quality rules, lines first: lines that fail a punctuation, navigation or boilerplate rule go, then documents that
are too short, too repetitive, or lose too much of their text.

Line rules, for lines that hold a word:
* navigation: at least 3 words are separators alone, and they are at least 15 % of the line's words;
* punctuation: more than one mark of # * $ % & | < > and of !! or ?? for every two words, or fewer than 3 words
  without a sentence mark at the end;
* boilerplate: at most 30 words, among them one of the phrases below (English, French, German, Spanish), or a line that
  the text has had at least twice before.
A document goes if it has fewer than 50 words, if repeated 3-word windows cover over half of its words, or if the
lines that go hold over 40 % of its words.

Defined cases: null text counts as empty: zero words, base_failed, not kept, cleaned text empty; repeated rows are
judged one by one; other columns are carried by quality() and left out of the query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "/", ">", "»", "›", "•", "·", "-", "::"]
#: Phrases of page furniture.
PHRASES = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "sign in to", "log in to", "subscribe to our", "click here", "read more", "skip to content", "back to top", "lorem ipsum",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "lire la suite", "se connecter", "retour en haut", "abonnez-vous à",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum und", "nutzungsbedingungen", "verwendet cookies", "cookies akzeptieren", "hier klicken", "jetzt anmelden", "nach oben", "newsletter abonnieren",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "aceptar cookies", "haga clic aquí", "leer más", "iniciar sesión", "volver arriba", "suscríbete a",
]
ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")")
MIN_WORDS, MOST_REPEATED, MOST_LOST, SHORT_LINE, BOILERPLATE_WORDS, MOST_TIMES = 50, 50, 40, 3, 30, 2
SEPARATOR_LEAST, SEPARATOR_SHARE = 3, 15

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_lines long, n_lost_words long, base_failed boolean, kept boolean"
FIELDS = FIGURES + ", clean_text string"


def line_fails(line: str, words: int, n_separators: int, before: int = 0) -> bool:
    """Whether a line with this many words, words that are separators alone, and equal lines before it goes."""
    if n_separators >= SEPARATOR_LEAST and 100 * n_separators >= SEPARATOR_SHARE * words:
        return True
    marks = sum(map(line.count, SYMBOLS)) + line.count("!!") + line.count("??")
    if 2 * marks > words or (words < SHORT_LINE and not line.rstrip(" \t\n\x0b\x0c\r").endswith(ENDS)):
        return True
    if words > BOILERPLATE_WORDS:
        return False
    if before >= MOST_TIMES:
        return True
    low = line.lower()
    return any(p in low for p in PHRASES)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
    base = np.uint64(len(ids))
    pairs = w[:-1] * base + w[1:]
    if len(ids) >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    windows = pairs[:-1] * base + w[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def judge(text: str | None, cleaned: bool = True) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: dict[str, int] = {}
    dup = lost_lines = lost_words = 0
    kept_lines = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            before = seen.get(line, 0)
            dup += before > 0
            seen[line] = before + 1
            if line_fails(line, len(own), sum(map(own.count, _SEPARATORS)) if any(s in line for s in SEPARATORS) else 0, before):
                lost_lines += 1
                lost_words += len(own)
                continue
        kept_lines.append(line)
    repeated = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n
    kept = not base_failed and 100 * lost_words <= MOST_LOST * n
    found = (n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeated, lost_lines, lost_words, base_failed, kept)
    return (*found, "\n".join(kept_lines)) if cleaned else found


_SEPARATORS = [s.encode() for s in SEPARATORS]
_COLUMNS = [f.split(" ")[0] for f in FIELDS.split(", ")]


def judged(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t) for t in texts], columns=_COLUMNS)


def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t, False) for t in texts], columns=_COLUMNS[:-1])


def quality(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """docs with its columns under `doc`, and the fields of FIELDS; clean_text, if asked for, is the text without the lines that go."""
    told = F.pandas_udf(judged, FIELDS) if cleaned else F.pandas_udf(measured, FIGURES)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), told("text").alias("q"))
    return own.select("doc", "q.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), cleaned=False).select("doc.doc_id", *_COLUMNS[:-1])


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l0 AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM d)),
l AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM l0),
v AS (SELECT doc_id, own, nth, len(own) AS n, len(list_filter(own, lambda x: list_contains({_sql_list(SEPARATORS)}, x))) AS seps,
      length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) + len(regexp_extract_all(line, '!!')) + len(regexp_extract_all(line, '\?\?')) AS marks,
      regexp_matches(line, '[.!?…:;"”»)][\x20\x09-\x0D]*\z') AS ended,
      len(list_filter({_sql_list(PHRASES)}, lambda p: contains(lower(line), p))) > 0 AS phrase FROM l WHERE len(own) > 0),
f AS (SELECT *, (seps >= 3 AND 100 * seps >= 15 * n) OR 2 * marks > n OR (n < 3 AND NOT ended) OR (n <= 30 AND (phrase OR nth > 2)) AS gone FROM v),
g AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (gone) AS n_lost_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_lost_words FROM f GROUP BY doc_id),
t AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
o AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_lines, 0) AS n_lost_lines, coalesce(n_lost_words, 0) AS n_lost_words
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 40 * n_words AS kept FROM o
"""
