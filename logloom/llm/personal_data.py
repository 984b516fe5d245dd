"""Personal data by weak supervision, in SQL functions and Spark ML alone.

Base rules find email, ip, card and phone spans by pattern and check. The method adds spans that these rules lose: a card beside
another number, a phone number followed by an address, numbers without a plus, written-out at and dot. Candidates come
from looser and stricter patterns. Four labelers vote on each (1, -1, or 0 for no opinion): its form, gazetteers (top-level domains,
card issuers, country codes), words before it, and what touches it. Per kind, expectation-maximisation estimates how often
each labeler votes so for true and for false candidates; base spans are held true, and a passed check (Luhn, parts, number of digits)
counts by the rate at which chance passes it. Its posteriors train a logistic regression on form, length, neighbours and votes over all
candidates, and candidates that it finds at least SURE likely, pass their check and overlap no base span are added.

A span depends on the text alone, so texts are known by two hashes, equal texts once; no text is shuffled. Matches are found by
marking them in the text and splitting it; their places are running sums over the matches of a text, so a text of any
length and number of matches takes one pass. What the driver gets are the counts of votes: at most 4 kinds x 81 votes x 4.

Defined cases: null text is empty: no spans, the hash of an empty string; repeated rows give a row each; a null doc_id is kept; U+0001 in a
text is read as U+0002, which no pattern holds; an empty table gives no rows; other columns are left out of the query.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The base rules' patterns. Where a run could be tried from each of its characters, a look behind starts it once; what can't give
#: characters back is possessive, which Java runs without recursion; a card begins with 13 digits, as shorter runs are dropped anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[(\[]\x20?(?:at|AT|@)\x20?[)\]]\x20?|\x20@\x20?|\x20at\x20|@)", r"(?:\x20?[(\[]\x20?(?:dot|DOT|\.)\x20?[)\]]\x20?|\x20dot\x20|\.)"
#: Candidates.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+)++",
    "ip": rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.+])(?:[0-9]{13,19}|[0-9]{4}([\x20./_-]|\x{A0})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20./_-])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|(?:\+|00)[0-9]{2,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4})(?![0-9A-Za-z])",
}
#: Texts without these hold no match of any pattern.
ANY = r"[0-9@]|[(\[]\x20?(?:at|AT)|\x20at\x20"
#: Gazetteers and context words (English, French, German, Spanish).
DOMAINS = "com org net edu gov info io co de fr es uk it nl eu ch at be us ca mx".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRIES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS = {
    "email": "mail|e-mail|email|contact|courriel|correo|write to|escribe",
    "ip": "ip|host|server|serveur|servidor|address|adresse|from",
    "card": "card|visa|mastercard|carte|karte|tarjeta|credit|kreditkarte",
    "phone": "tel|phone|call|fax|mobile|mobil|handy|telefon|téléphone|teléfono|móvil|appelez",
}
AGAINST = r"(?:version|isbn|issn|order|invoice|page|token|id|sku|nr|no|n°|#|\$|€|=)\W{0,3}$"
LABELERS = ("form", "gazetteer", "words", "touch")
#: How often a false candidate passes its kind's check: one Luhn digit of ten; four parts of three digits; no check for email.
CHANCE, TINY = {"email": 1.0, "ip": 0.05, "card": 0.1, "phone": 0.5}, 1e-6
BEFORE, AFTER, SURE, ROUNDS, SMOOTH = 32, 8, 0.8, 60, 2.0
MARK, OTHER = "\x01", "\x02"


def matches(text: Column, pattern: str) -> Column:
    """Array of nth (from 1), gap (code points since the last match), value, before, after of a pattern's matches, in order."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    at = lambda p, i: F.get(p, i)
    one = lambda p: lambda i: F.struct(i.alias("nth"), F.char_length(at(p, i - 1)).alias("gap"), at(p, i).alias("value"), F.right(at(p, i - 1), F.lit(BEFORE)).alias("before"), F.left(at(p, i + 1), F.lit(AFTER)).alias("after"))
    odd = lambda p: F.when(F.size(p) > 2, F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    # As the one element of an array the pieces have a name, so the text is split once.
    return F.flatten(F.transform(F.array(pieces), lambda p: F.transform(odd(p), one(p))))


def found(docs: DataFrame, patterns: dict[str, dict[str, str]]) -> DataFrame:
    """k1, k2 (the text), role (of patterns), kind, value, before, after, start, end of all matches."""
    text = F.translate("text", MARK, OTHER)
    own = docs.where(F.col("text").rlike(ANY)).select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), text.alias("text"))
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), matches(F.col("text"), p).alias("m")) for role, of in patterns.items() for kind, p in of.items()]))
    rows = own.select("k1", "k2", each.alias("x")).select("k1", "k2", "x.role", "x.kind", F.explode("x.m").alias("m")).select("k1", "k2", "role", "kind", "m.*").distinct()
    upto = Window.partitionBy("k1", "k2", "role", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(upto))
    return ends.select("k1", "k2", "role", "kind", "value", "before", "after", (F.col("end") - F.char_length("value")).alias("start"), "end")


def digits(value: Column | str) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits d, not empty, pass the check."""
    n = F.length(d)
    at = lambda i: F.substr(d, n - i + 1, F.lit(1)).cast("int")
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 2 == 0, 2 * at(i) - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid() -> Column:
    """Whether a match of its kind passes the check: parts of at most 255, 13 to 19 digits and Luhn, 9 to 15 digits."""
    d, part = digits("value"), "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dots = F.regexp_replace("value", r"[^0-9]+", ".")
    card = F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    return F.when(F.col("kind") == "ip", dots.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", F.length(d).between(9, 15)).otherwise(True)


def votes() -> dict[str, Column]:
    """Each labeler's vote on a candidate row."""
    d, kind, value = digits("value"), F.col("kind"), F.col("value")
    of = lambda **by: F.coalesce(*[F.when(kind == k, c) for k, c in by.items()])
    yes = lambda c, no=-1: F.when(c, 1).otherwise(no)
    dull = d.rlike(r"^([0-9])\1{6,}$") | F.contains(d, F.lit("12345678")) | F.contains(d, F.lit("87654321"))
    form = of(email=yes(~F.contains(value, F.lit(" ")), 0), ip=yes(value.rlike(r"^[0-9.]+$"), 0), card=yes(F.length(d).isin(15, 16), 0), phone=yes(value.rlike(r"^(?:\+|00)"), 0))
    gazetteer = of(
        email=yes(F.regexp_extract(F.lower("value"), "([a-z0-9]+)$", 1).isin(DOMAINS)), ip=yes(~value.rlike(r"^(?:0|127|255)\."), -1), card=yes(d.rlike(ISSUERS)),
        phone=F.when(value.rlike(r"^(?:\+|00)"), yes(F.regexp_replace(d, "^00", "").rlike(COUNTRIES))).otherwise(0),
    )
    said = F.lower("before")
    words = F.when(said.rlike(AGAINST), -1).when(of(**{k: said.rlike(rf"(?:^|[^\p{{L}}])(?:{w})(?![\p{{L}}])") for k, w in WORDS.items()}), 1).otherwise(0)
    glued = F.col("before").rlike(r"[\p{L}0-9_/\\@=\"'<+]$") | F.col("after").rlike(r"^[\p{L}0-9_/\\@=\"'>]")
    return dict(zip(LABELERS, (F.when(dull, -1).otherwise(form), gazetteer, words, yes(~glued)), strict=True))


def _touches(rows: DataFrame) -> Column:
    """Whether a row overlaps a base span of its text: some base span that begins no later ends after its start, or the next one begins before its end."""
    upto = Window.partitionBy("k1", "k2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("k1", "k2").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    base = F.col("role") == "base"
    return (F.coalesce(F.max(F.when(base, F.col("end"))).over(upto), F.lit(0)) > F.col("start")) | F.coalesce(F.min(F.when(base, F.col("start"))).over(past) < F.col("end"), F.lit(False))


def candidates(docs: DataFrame) -> DataFrame:
    """k1, k2, role (base or loose), kind, start, end of base spans and candidates; of these also known (1 where a base span, else 0), check (1 or -1), votes and features."""
    rows = found(docs, {"base": BASE, "loose": LOOSE}).withColumn("valid", valid()).where("role = 'loose' or valid")
    rows = rows.withColumn("touches", _touches(rows))
    same = Window.partitionBy("k1", "k2", "kind", "start", "end")
    rows = rows.withColumn("in_base", F.max(F.expr("int(role = 'base')")).over(same) == 1)
    sign = F.substring(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"[\p{L}]+", "a"), 1, 24)
    edge = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "blank").when(c.rlike(r"[\p{L}0-9]"), "word").otherwise(c)
    return rows.select(
        "k1", "k2", "role", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "touches", F.col("in_base").cast("int").alias("known"), F.when(F.col("valid"), 1).otherwise(-1).alias("check"), *[v.alias(n) for n, v in votes().items()],
        F.concat_ws(":", "kind", sign).alias("sign"), F.concat_ws(":", "kind", F.length(digits("value"))).alias("length"), edge(F.right("before", F.lit(1))).alias("left"), edge(F.left("after", F.lit(1))).alias("right"),
    )


def reliabilities(counted: list[tuple], rounds: int = ROUNDS, smooth: float = SMOOTH) -> dict[tuple, float]:
    """Posterior of each (kind, known, check, votes) from rows (kind, known, check, votes..., count): one latent truth per candidate, votes independent given it.

    Beliefs before any data: half of the candidates are true, and a labeler that votes is right four times out of five.
    True candidates pass their check but for one in a thousand, false ones by chance (CHANCE).
    """
    out: dict[tuple, float] = {}
    labelers, believed = range(len(LABELERS)), {1: 0.8, -1: 0.2, 0: 0.5}
    for kind in {r[0] for r in counted}:
        rows = [(r[1], r[2], r[3:-1], r[-1]) for r in counted if r[0] == kind]
        passed = {1: log(0.999 / CHANCE[kind]), -1: log(0.001 / (1.001 - CHANCE[kind]))}
        p = [1 - TINY if known else 0.5 for known, *_ in rows]
        for _ in range(rounds):
            mass = {1: smooth, 0: smooth}
            seen = {(j, y, v): smooth * (believed[v] if y else 1 - believed[v]) for j in labelers for y in (1, 0) for v in (1, 0, -1)}
            for (_, _, vs, n), q in zip(rows, p, strict=True):
                for y, w in ((1, n * q), (0, n * (1 - q))):
                    mass[y] += w
                    for j, v in enumerate(vs):
                        seen[j, y, v] += w
            whole = {(j, y): sum(seen[j, y, v] for v in (1, 0, -1)) for j in labelers for y in (1, 0)}
            new = []
            for known, check, vs, _ in rows:
                odds = log(mass[1] / mass[0]) + passed[check] + sum(log(seen[j, 1, v] / whole[j, 1]) - log(seen[j, 0, v] / whole[j, 0]) for j, v in enumerate(vs))
                new.append(1 - TINY if known else min(1 - TINY, max(TINY, 1 / (1 + exp(-max(-30.0, min(30.0, odds)))))))
            p = new
        out |= {(kind, known, check, *vs): q for (known, check, vs, _), q in zip(rows, p, strict=True)}
    return out


def _features(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import FeatureHasher

    of_kind = {f"x_{n}": F.concat_ws(":", "kind", F.col(n).cast("string")) for n in ("left", "right", "check", *LABELERS)}
    names = ["sign", "length", *of_kind]
    return FeatureHasher(inputCols=names, outputCol="features", numFeatures=1 << 12).transform(rows.withColumns(of_kind))


def added(rows: DataFrame, sure: float = SURE) -> DataFrame:
    """k1, k2, kind, start, end of the candidates that the classifier accepts; rows is candidates()."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    spark, loose = rows.sparkSession, rows.where("role = 'loose'")
    key = ["kind", "known", "check", *LABELERS]
    counted = [tuple(r) for r in loose.groupBy(*key).count().collect()]
    if not counted:
        return loose.select("k1", "k2", "kind", "start", "end")
    told = ", ".join(f"('{k[0]}', {', '.join(map(str, k[1:]))}, {q:.9f}D)" for k, q in sorted(reliabilities(counted).items()))
    posterior = spark.sql(f"SELECT * FROM VALUES {told} AS t({', '.join(key)}, p)")
    shapes = loose.groupBy(*key, "sign", "length", "left", "right").count().join(F.broadcast(posterior), key)
    soft = shapes.select("*", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("count") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("count") * (1 - F.col("p"))).alias("weight")))).alias("y")).select("*", "y.*")
    model = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(_features(soft))
    open_ = loose.where("known = 0 and check = 1 and not touches")
    return model.transform(_features(open_)).where(vector_to_array("probability")[1] >= sure).select("k1", "k2", "kind", "start", "end")


def spans(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """k1, k2, kind, start, end, base of every span of every distinct text of docs (text)."""
    rows = written(candidates(docs))
    own = rows.where("role = 'base'").select("k1", "k2", "kind", "start", "end")
    return own.withColumn("base", F.lit(True)).unionByName(added(rows, sure).withColumn("base", F.lit(False)))


def _listed(of: Column) -> Column:
    order = F.array_sort(F.filter(of, lambda x: x.isNotNull()))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["at"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; overlapping spans are one, named by the first."""
    all_spans = spans(docs, sure)
    upto = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = all_spans.withColumn("fresh", F.coalesce(F.col("start") >= F.max("end").over(upto), F.lit(True)).cast("int"))
    apart = apart.withColumn("nth", F.sum("fresh").over(Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    one = apart.groupBy("k1", "k2", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    lists = one.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cut"))
    own = docs.withColumns({"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")}).join(lists.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("cut", lambda x: x["end"]))
    tos = F.concat(F.transform("cut", lambda x: x["start"]), F.array(F.char_length("text").cast("long")))
    gaps = F.zip_with(froms, tos, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    names = F.concat(F.transform("cut", lambda x: F.concat(F.lit("<"), x["kind"], F.lit(">"))), F.array(F.lit("")))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(gaps, names, lambda a, b: F.concat(a, b)), ""))
    return own.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    found_ = spans(docs).withColumn("x", F.struct(at.alias("at"), "start", "end"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    of_text = found_.groupBy("k1", "k2").agg(*counts, _listed(F.collect_list(F.when(F.col("base"), F.col("x")))).alias("of_base"), _listed(F.collect_list("x")).alias("of_all"))
    own = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return own.join(of_text, ["k1", "k2"], "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(none(F.col("of_base")), 256).alias("base_sha256"), none(F.col("of_all")).alias("spans")
    )
