"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s   -     　﻿]"
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7FF}\x{3000}-\x{303F}]"


def once(value: Column, told: Callable[[Column], Column]) -> Column:
    """What told makes of a value that is found once, however often it is read."""
    return F.transform(F.array(value), told)[0]


def made_once(value: Column) -> Column:
    """The value, for one column of a select: conditions on it, and what reads it, don't make it again."""
    return F.explode_outer(F.array(value))


def trim_blank(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def sanitize(text: Column) -> Column:
    """Line ends as LF, without terminal escape sequences and control characters."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    escapes = r"(?:\x1b\[|\x9b)[0-9:;?><!<= ]*[ -/]*[@-~]|(?:\x1b[\]P^_X]|\x9d)[^\x07\x1b\n]*(?:\x07|\x1b\\|\x9c)"
    return F.regexp_replace(F.regexp_replace(lines, escapes, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def clip(text: Column, most: int = 200) -> Column:
    """At most `most` characters, at the last space if that lies beyond 60 % of them."""
    head = F.substring(text, 1, most + 1)
    at = F.lit(most + 1) - F.instr(F.reverse(head), " ")  # place before the last space
    end = F.when((F.instr(head, " ") > 0) & (at > int(most * 0.6)), at).otherwise(F.lit(most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), end.cast("int")))


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_blank), lambda x: x != "")


def first_line(text: Column, most: int = 200) -> Column:
    return clip(F.element_at(F.split(text, "\n"), 1), most)


def snippet(text: Column, term: str, radius: int = 60) -> Column:
    """What surrounds the first occurrence of term, whatever its case; null without one."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + len(term) + radius, F.char_length(text) + 1)
    body = F.substring(text, start, end - start)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end <= F.char_length(text), "...").otherwise(""))
    return F.when(at > 0, cut)


def script_tokens(text: Column) -> Column:
    """Estimated tokens: one per CJK character, one for every four others."""
    text = F.coalesce(text, F.lit(""))
    other = F.char_length(F.regexp_replace(text, CJK, ""))
    return (F.char_length(text) - other + F.ceil(other / 4)).cast("long")


def is_dense(text: Column) -> Column:
    """Whether under 70 % of the characters are letters A-Z or spaces."""
    share = F.char_length(F.regexp_replace(text, "[^A-Za-z ]", "")) / F.char_length(text)
    return F.when(F.char_length(text) > 0, share < 0.7).otherwise(False)


def chars_per_token(chars: Column, tokens: Column, head: Column, tail: Column) -> Column:
    """Calibrated characters per token, between 2 and 6; 4 (dense text 3, CJK 2) where the ratio can't be true."""
    raw = chars / tokens
    cjk = (F.char_length(head) - F.char_length(F.regexp_replace(head, CJK, ""))) / F.char_length(head) >= 0.2
    prior = F.when(is_dense(head) | is_dense(tail), 3.0).otherwise(4.0)
    known = F.when(~cjk & (raw < 2.5), prior).when(cjk & (raw > 3), 2.0).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(6.0), raw)))
    return F.when((tokens > 0) & (chars > 0), F.when(F.char_length(head) > 0, known).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(6.0), raw)))).otherwise(4.0)


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -3)


def format_tokens(n: Column) -> Column:
    """Thousands with one decimal of the exact quotient, ties up; fewer as they are."""
    tie = F.when(n % 1000 == 250, 1).otherwise(0)  # the one exact tie that rounding to even takes down
    return F.when(n >= 1000, F.concat(F.replace(F.format_number((n + tie) / 1000, 1), F.lit(",")), F.lit("k"))).otherwise(n.cast("string"))


def filesystem_path(args: Column, keys: tuple[str, ...] = ("path", "file_path", "filePath", "file")) -> Column:
    """First value under keys of a JSON object text that is a path and no URI."""
    values = [F.get_json_object(args, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when((v != "") & ~v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), v) for v in values])


def clip_sentence(text: Column, most: int = 200) -> Column:
    """At most `most` characters: up to the last end of a sentence beyond half of them, else as clip does."""
    whole = F.regexp_extract(F.substring(text, 1, most), r"^([\s\S]*[.!?])(?=\s|\z)", 1)
    return F.when(F.char_length(text) <= most, text).when(F.char_length(whole) >= most * 0.5, whole).otherwise(clip(text, most))


def clip_bytes(text: Column, most: int) -> Column:
    """Whole characters within so many UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    starts = lambda n: ~F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]")  # noqa: E731  a character starts after n bytes
    end = F.when(starts(most), most).when(starts(most - 1), most - 1).when(starts(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))


def line_snippet(text: Column, pattern: str, around: int = 2, most: int = 2000) -> Column:
    """The first line that matches, with lines around it and how many lie beyond; null without one. Lines longer than
    `most` keep what surrounds the match (other lines: their start)."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)).cast("int")
    lo, hi = F.greatest(at - around, F.lit(1)), F.least(at + around, F.size(lines))
    budget = most - 64

    def clipped(line: Column) -> Column:
        place = F.greatest(F.regexp_instr(line, F.lit(pattern)) - 1, F.lit(0))
        hit = F.least(F.coalesce(F.char_length(F.regexp_substr(line, F.lit(pattern))), F.lit(0)), F.lit(budget))
        start = F.greatest(place - F.floor((budget - hit) / 2), F.lit(0))
        start = F.least(start, F.char_length(line) - budget).cast("int")
        after = F.char_length(line) - start - budget
        before = F.when(start > 0, F.concat(F.lit("...("), start.cast("string"), F.lit(" chars before)"))).otherwise("")
        return F.when(F.char_length(line) <= most, line).otherwise(
            F.concat(before, F.substring(line, start + 1, F.lit(budget)), F.when(after > 0, F.concat(F.lit("...("), after.cast("string"), F.lit(" chars after)"))).otherwise(""))
        )

    above = F.when(lo > 1, F.concat(F.lit("...("), (lo - 1).cast("string"), F.lit(" lines above)")))
    below = F.when(hi < F.size(lines), F.concat(F.lit("...("), (F.size(lines) - hi).cast("string"), F.lit(" lines below)")))
    return F.when(at > 0, F.concat_ws("\n", above, F.array_join(F.transform(F.slice(lines, lo, hi - lo + 1), clipped), "\n"), below))


def escape_commas(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"[\r\n]+", " "), F.lit(","), F.lit("\\,"))


def split_escaped(listed: Column) -> Column:
    """escape_commas undone for a list joined by commas."""
    items = F.transform(F.split(listed, r"(?<!\\),"), lambda x: F.trim(F.replace(x, F.lit("\\,"), F.lit(","))))
    return F.filter(items, lambda x: x != "")


def query_of(text: Column, most: int = 6) -> Column:
    """The first tokens of at least three characters, as a query."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_./-]{3,}"), F.lit(0)), 1, most), " ")


def holds_terms(text: Column, query: Column) -> Column:
    """Whether every term of a query occurs, whatever its case."""
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), lambda t: F.contains(F.lower(text), t))


def tokens_of_chars(chars: Column, per_token: Column) -> Column:
    return F.ceil(chars / per_token).cast("long")


def joined_within(parts: Column, most: int) -> Column:
    """Parts joined by LF, the first characters."""
    return F.substring(F.array_join(parts, "\n"), 1, most)


def positive_or(value: Column, least: int, default: int) -> Column:
    """A number as a whole one from `least` on; the default where it is missing or not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.greatest(F.lit(least), F.floor(value))).otherwise(default).cast("long")
