"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier over byte n-grams predicts each bit (regularised least squares,
fitted exactly). A text goes to the codeword with the least total hinge loss, each bit weighted by the log odds that its
classifier is right on fitting rows left out one at a time (which the least-squares solution gives in closed form);
where the runner-up is close, the text is flagged as ambiguous. Up to five languages have all distinct splits as bits;
more have random balanced bits, of which the draw with the greatest least distance between codewords is taken.

The fit uses a bounded sample: of each language at most `per_language` rows and an equal part of `most_rows`, least hash
of doc_id and text first, whole texts. Only rows with a known language and crc32(doc_id) mod 4 other than 2 are used. Beyond
`most_rows` languages the most frequent ones are learned.

Defined cases: null texts and texts without a letter are `und` with score 0 and ambiguous; without fitting rows
every text is `und`; with one language every text with a letter has it; repeated rows are judged one by one, and of rows
that repeat a doc_id and text the fit takes one; other columns are carried by with_language()
and left out of the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PER_LANGUAGE, MOST_ROWS, BUCKETS = 500, 2000, 4096
RIDGE, CLOSE, DRAWS = 1e-3, 0.03, 200
UNKNOWN = "und"


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vector of hashed byte 3-grams of a text in lower case, and a constant."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - int(buckets).bit_length() + 1)
    x = np.sqrt(np.bincount(code, minlength=buckets).astype(np.float32))
    return np.append(x / max(float(np.sqrt(x @ x)), 1e-9), np.float32(1))


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: all distinct splits of up to 5 languages; of more the best of DRAWS random codes of balanced bits."""
    if n <= 5:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 2 ** (n - 1))] for i in range(n)], float).reshape(n, -1)
    bits, draw = 12 * int(np.ceil(np.log2(n))), np.random.default_rng(6)
    half = np.where(np.arange(n) < n // 2, -1.0, 1.0)
    best = max((np.stack([draw.permutation(half) for _ in range(bits)], axis=1) for _ in range(DRAWS)), key=least_distance)
    if not least_distance(best):
        raise ValueError("two languages have the same codeword")
    return best


def least_distance(code: np.ndarray) -> int:
    """Bits in which the two nearest codewords differ."""
    apart = (code.shape[1] - code @ code.T) / 2
    apart[np.diag_indices(len(code))] = code.shape[1]
    return int(apart.min())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weights of one classifier per bit, and the codewords."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(max(2, len(langs)))
        if len(langs) > 1:
            bits = self.code[y]
            kernel = (x @ x.T).astype(float)
            kernel[np.diag_indices(len(x))] += RIDGE * len(x) / 100
            inverse = np.linalg.inv(kernel)
            dual = inverse @ bits
            self.weights = (x.T @ dual.astype(np.float32)).astype(np.float32)
            # What each row would get from a fit without it.
            left_out = bits - dual / np.diag(inverse)[:, None]
            right = (left_out * bits > 0).sum(axis=0)
            self.trust = np.maximum(0.05, np.log((right + 0.5) / (len(x) - right + 0.5)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if len(self.langs) == 1:
            for i in at:
                out[i] = (self.langs[0], 1.0, False)
            return out
        for k in range(0, len(at), 256):
            own = at[k : k + 256]
            f = np.stack([counts(texts[i]) for i in own]) @ self.weights
            loss = np.stack([(np.maximum(0, 1 - f * c) * self.trust).sum(axis=1) for c in self.code], axis=1) / self.trust.sum()
            order = np.argsort(loss, axis=1, kind="stable")
            p = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for r, i in enumerate(own):
                a, b = order[r, :2]
                out[i] = (self.langs[a], float(p[r, a]), bool(loss[r, b] - loss[r, a] < CLOSE))
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Model of the languages of docs, from at most most_rows rows, and per_language of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.xxhash64(F.lit(1), "text").alias("th"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows).collect()
    quota = {r["lang"]: min(r["count"], per_language, max(1, most_rows // len(sizes))) for r in sizes}

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counts(t).astype(np.float16).tobytes())

    # Hashes of different rows are even, so below the bound lie about four times the rows wanted; only where many rows repeat
    # one another are there too few, and the bound rises for that language. At most its quota of rows reaches the driver.
    rows, share = [], {r["lang"]: 4 * quota[r["lang"]] / r["count"] for r in sizes}
    while share:
        bounds = docs.sparkSession.createDataFrame([(x, int(min(1, p) * (2**64 - 1)) - 2**63, quota[x]) for x, p in share.items()], "lang string, bound long, quota int")
        below = known.join(F.broadcast(bounds), "lang").where("h <= bound").dropDuplicates(["lang", "h", "th"])
        near = below.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "th"))).where("nth <= quota")
        found: dict[str, list] = {x: [] for x in share}
        for r in near.select("lang", "h", "th", vectors("text").alias("x")).collect():
            found[r.lang].append((r.lang, r.h, r.th, bytes(r.x)))
        done = [x for x in share if len(found[x]) == quota[x] or share[x] >= 1]
        rows += [(x, vector) for lang in done for x, _, _, vector in sorted(found[lang])]
        share = {x: 4 * p for x, p in share.items() if x not in done}
    langs = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(langs)}
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, BUCKETS + 1), np.float32)
    return Model(langs, x, np.array([place[r[0]] for r in rows], int))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its columns under `doc`, and lang_pred, score, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS rows, a column for each bit

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def named(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame(sent.value.predict(list(texts)), columns=["lang_pred", "score", "ambiguous"])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), named("text").alias("p"))
    return own.select("doc", "p.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language cannot be told (no letter, or ambiguous)."""
    told = with_language(docs, fit(docs)).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return told.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = with_language(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
