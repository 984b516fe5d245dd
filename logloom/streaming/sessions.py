"""Session logs as a stream: a folder of JSON lines, kept per session, with the state that a batch run would compute."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "messages long, since_marker long, users long"
OUT = "session_id string, messages long, since_marker long, users long"


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, type and role of every JSON line that arrives in a folder; lines that are no JSON are left out."""
    lines = spark.readStream.format("text").load(folder)
    get = lambda path: F.try_variant_get("entry", path, "string")
    parsed = lines.select(F.try_parse_json("value").alias("entry")).where("entry is not null")
    return parsed.select(get("$.session").alias("session_id"), get("$.type").alias("type"), get("$.message.role").alias("role")).where("session_id is not null")


def _grow(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    messages, since, users = state.get if state.exists else (0, 0, 0)
    for part in parts:
        message = part["type"].eq("message").to_numpy()
        markers = part["type"].isin(["compaction", "reset_boundary"]).to_numpy().nonzero()[0]
        users += int((message & part["role"].eq("user").to_numpy()).sum())
        since = int(message[markers[-1] + 1 :].sum()) if len(markers) else since + int(message.sum())
        messages += int(message.sum())
    state.update((messages, since, users))
    yield pd.DataFrame({"session_id": [key[0]], "messages": [messages], "since_marker": [since], "users": [users]})


def live_counts(lines: DataFrame) -> DataFrame:
    """Per session: messages, messages since the last marker, user messages; a marker starts the live window anew."""
    return lines.groupBy("session_id").applyInPandasWithState(_grow, OUT, STATE, "update", "NoTimeout")
