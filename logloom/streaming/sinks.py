"""A table fed by micro-batches, exactly once: a batch that runs twice, or fails between its rows and its commit, counts once.

Every batch owns a folder that a rerun overwrites, and a mark in the ledger, written last. Readers see marked folders
only, and of each key the row of the newest batch, so no batch reads or rewrites what earlier ones wrote. Folding puts the
newest rows of all marked batches in one folder; later reads start from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def marks(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Numbers of committed batches (`batch`) and folds (`fold`), in order."""
    fs, path = _files(spark, f"{folder}/_ledger")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {kind: sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-")) for kind in ("batch", "fold")}


def _mark(spark: SparkSession, folder: str, name: str) -> None:
    fs, path = _files(spark, f"{folder}/_ledger/{name}")
    fs.create(path, True).close()


def upsert_batch(folder: str, keys: list[str]):
    """A function for foreachBatch: the newest row of each key, by the table's keys."""

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if batch_id in marks(spark, folder)["batch"]:
            return
        rows.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        _mark(spark, folder, f"batch-{batch_id}")

    return run


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The newest row of each key; none before the first commit."""
    known = marks(spark, folder)
    fold = known["fold"][-1] if known["fold"] else None
    parts = [spark.read.parquet(f"{folder}/batch={b}").withColumn("__batch", F.lit(b)) for b in known["batch"] if fold is None or b > fold]
    if fold is not None:
        parts.append(spark.read.parquet(f"{folder}/fold={fold}").withColumn("__batch", F.lit(fold)))
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    others = [c for c in rows.columns if c not in (*keys, "__batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__row"))
    return newest.select(*keys, *[F.col("__row").getField(c).alias(c) for c in others])


def fold(spark: SparkSession, folder: str, keys: list[str]) -> None:
    """The newest rows of all committed batches as one folder; what it replaces may be deleted by drop_folded()."""
    done = marks(spark, folder)["batch"]
    if done and (rows := latest(spark, folder, keys)) is not None:
        rows.write.mode("overwrite").parquet(f"{folder}/fold={done[-1]}")
        _mark(spark, folder, f"fold-{done[-1]}")


def drop_folded(spark: SparkSession, folder: str) -> None:
    """Rows of batches and folds before the newest fold; their marks stay, so no rerun adds them again."""
    known = marks(spark, folder)
    newest = known["fold"][-1] if known["fold"] else -1
    for name in [f"batch={b}" for b in known["batch"] if b <= newest] + [f"fold={n}" for n in known["fold"][:-1]]:
        fs, path = _files(spark, f"{folder}/{name}")
        fs.delete(path, True)
