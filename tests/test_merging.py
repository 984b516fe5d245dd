"""Summaries merged as text against a plain merge, and file sections there and back."""

import random
import re

from pyspark.sql import functions as F

from logloom.functions import brief as T
from logloom.operators import merging, summary

TITLES = summary.TITLES


def wrap(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "session_id string, summary string")
    return df.withColumn("summary", T.wrapped(F.col("summary")))


def random_paths(rng, n):
    parts = ["src", "lib,2", "très long dossier", "a" * 70, "x y", "t"]
    return list(dict.fromkeys(rng.choice(["/", "/r/", "", "/r/q/"]) + "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + f"/f{rng.randrange(400)},{k}.py" for k in range(n)))


def test_file_sections_there_and_back(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k, n in enumerate([0, 1, 2, 5, 19, 20, 21, 60, 100, 101, 150] * 2):
        for category in ("Modified", "Created", "Read")[: 1 + k % 3]:
            paths = random_paths(rng, n)
            rows += [(f"s{k}", category, p, i) for i, p in enumerate(paths)]
            want[f"s{k}", category] = paths[:100]
    files = spark.createDataFrame(rows, "session_id string, category string, path string, first_blk long")
    text = merging.file_section(files).select("session_id", T.wrapped(F.concat("files", F.lit("\n\n[Commits]\n- x"))).alias("summary")).cache()
    assert max(len(x) for r in text.collect() for x in r.summary.split("\n")) <= 120
    got = {}
    for r in merging.file_rows(text).orderBy("session_id", "category", "first_blk").collect():
        got.setdefault((r.session_id, r.category), []).append(r.path)
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items() if v}
    assert all(got[k][:20] == v[:20] for k, v in want.items() if v)
    text.unpersist()


def plain_section(text, title):
    head = text.split(summary.RULE)[0]
    m = re.search(rf"(?:^|\n)\[{re.escape(title)}\]", head)
    if not m:
        return ""
    rest = head[m.end() :]
    ends = [x.start() for t in TITLES.values() if t != title for x in [re.search(rf"\n\[{re.escape(t)}\]", rest)] if x]
    return (f"[{title}]" + rest[: min(ends, default=len(rest))]).strip()


def plain_lines(part):
    out = []
    for line in part.split("\n"):
        if out and re.match(r"\s+\S", line):
            out[-1] = out[-1][:-1] + line.strip() if out[-1].endswith("\\") else f"{out[-1]} {line.strip()}"
        else:
            out.append(line)
    return [x for x in out if x.startswith("- ")]


def plain_merge(old, new):
    made = []
    for name, title in TITLES.items():
        a, b = plain_section(old, title), plain_section(new, title)
        if name == "blockers":
            made.append(b or a)
        elif name == "files":
            made.append("FILES" if a else b)
        elif not a or not b:
            made.append(a or b)
        else:
            lines, most = list(dict.fromkeys(plain_lines(a) + plain_lines(b))), summary.MERGED_MOST[name]
            if len(lines) > most:
                lines = [lines[0], *lines[-(most - 1) :]] if name == "goals" else lines[-most:]
            made.append(f"[{title}]\n" + "\n".join(lines))
    return made


def test_merged_text(spark):
    rng = random.Random(8)
    old, new = {}, {}
    for k in range(40):
        for side in (old, new):
            parts = []
            for name, title in TITLES.items():
                n = rng.choice([0, 1, 3, 12])
                if not n:
                    continue
                if name == "files":
                    parts.append(f"[{title}]\n- Modified (in /r/s/): a\\,{k}.py, {rng.choice('bc')}.py (+3 more)\n- Read (+2 more under /d/): x, y\n- Read (+9 more)\n- Created: /n{rng.randrange(3)}, /r/s/b.py")
                else:
                    parts.append(f"[{title}]\n" + "\n".join(f"- {name} {rng.randrange(9)} " + "word " * rng.choice([0, 40]) + "x" * rng.choice([0, 200]) for _ in range(n)))
            brief = rng.choice(["", "[user]\nold talk", "[user]\n" + "\n".join(f"l{i}" for i in range(90)), "plain --- talk"])
            side[f"s{k}"] = summary.RULE.join(x for x in ("\n\n".join(parts), brief) if x)
    a, b = wrap(spark, old).cache(), wrap(spark, new).cache()
    before = {r.session_id: r.summary for r in a.collect()}, {r.session_id: r.summary for r in b.collect()}
    got = {r.session_id: r.summary for r in merging.merged_summaries(a, b, note=False).collect()}
    for k, text in got.items():
        made = plain_merge(before[0][k], before[1][k])
        assert all(len(x) <= 120 for x in text.split("\n"))
        for title, want in zip(TITLES.values(), made, strict=True):
            have = plain_section(text, title)
            if want == "FILES":
                assert f"a\\,{k[1:]}.py" in have and "more)" not in have.replace("(+2 more under", "") and "x" in have
                modified = next(x for x in plain_lines(have) if x.startswith("- Modified"))
                created = next((x for x in plain_lines(have) if x.startswith("- Created")), "")
                assert "b.py" not in created or "b.py" not in modified
            else:
                assert plain_lines(have) == plain_lines(want) and bool(have) == bool(want), (k, title)
    assert set(got) == set(old)
    # Merging with nothing changes nothing but the note; the note is never merged into the brief.
    none = spark.createDataFrame([], "session_id string, summary string")
    noted = a.withColumn("summary", F.concat("summary", F.lit(summary.RULE + summary.NOTE)))
    same = {r.session_id: r.summary for r in merging.merged_summaries(noted.where("summary not like '%omitted%'"), none).collect()}
    assert all(t.count("Use the recall search") == 1 for t in same.values() if t) and merging.merged_summaries(none, none).count() == 0
    a.unpersist()
    b.unpersist()


def test_lines_and_briefs(spark):
    df = spark.createDataFrame([("- a\\\n  b\n- c\n  d\ne",), ("x",), ("",)], "t string").select(merging.joined_lines(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["- ab", "- c d", "e"], ["x"], [""]]
    rule = summary.RULE
    texts = {"[Commits]\n- x" + rule + "b" + rule + "c": "b" + rule + "c", "[Commits]\n- x": "", "no sections" + rule + "here": "no sections" + rule + "here", "": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merging.brief_of(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == texts
