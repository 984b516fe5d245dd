"""What the training-data operators share: words, table access, the shared folder and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import forget, shared_dir, written  # noqa: F401  the operators take these from here

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot from HOT_ROWS rows on, and from a HOT_SHARE-th of all rows on: so there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def hot_from(total: int) -> int:
    """Rows from which a key of `total` rows is hot."""
    return max(HOT_ROWS, total // HOT_SHARE)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, least: int) -> DataFrame:
    """Inner join with right, whose keys are unique and whose column `rows` counts the rows of left with that key.

    The keys with `least` rows or more (hot_from(): at most HOT_SHARE, so safe to broadcast) meet left where it lies; the
    others are shuffled, so no task gets more than `least` rows of one key. Both sides should be cheap to read twice.
    """
    hot = right.where(F.col(rows) >= least)
    if hot.isEmpty():
        return left.join(right, on)
    return left.join(F.broadcast(hot), on).unionByName(left.join(right.where(F.col(rows) < least), on))
