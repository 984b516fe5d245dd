"""Queries that replay a table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sessions import table
from ..sources.shared import shared_dir
from ..streaming import chains, sinks
from .catalog import ORACLES, query
from . import recall  # noqa: F401  whose active_chain says what the replay must give


@query(ORACLES["active_chain"])
def stream_active_chain(spark, d):
    """active_chain, kept as state by a stream over the table's files and upserted once per micro-batch."""
    turns = table(spark, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    # As a pattern the path may name one file or a folder of files.
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/conversations.parque[t]")
    rows = stream.join(last, "conv_id").withColumn("k", F.expr("conv_id % 7")).selectExpr(
        "cast(conv_id AS string) AS session_id", "0L AS generation", "turn AS seq", "CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE concat('e', turn) END AS entry_id", "true AS is_summary", "k <> 5 OR turn > 0 AS append",
        "turn = CASE WHEN k = 3 THEN 1 ELSE 0 END AS chain_start", "turn + CASE WHEN k = 3 THEN 0 ELSE 1 END + CASE WHEN k = 2 AND turn = 1 THEN 1 ELSE 0 END AS sequence",
        "concat('e', turn) AS first_covered", "concat('e', turn) AS last_covered", "CASE WHEN turn = last OR k = 1 THEN '' WHEN k = 4 AND turn = 1 THEN 'e0' ELSE concat('e', turn + 1) END AS first_kept",
    )
    folder = shared_dir(spark)
    before = {k: spark.conf.get(k, None) for k in (chains.STORE_KEY, chains.EMPTY_KEY)}
    chains.use_state_store(spark, once=True)
    try:
        run = chains.live_chains(rows).writeStream.outputMode("update").foreachBatch(sinks.upsert_batch(f"{folder}/table", ["session_id"]))
        run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = chains.chain_rows(sinks.latest(spark, f"{folder}/table", ["session_id"]))
    return found.select(F.col("session_id").cast("long").alias("session_id"), "seq", "sequence")
