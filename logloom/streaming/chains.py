"""Append chains as state: the rows of windows.active_chain kept up to date while a log grows, entry by entry.

State per session: the current generation, a map of entry ids to places, and the list of summaries from the newest chain
start on. Every row is applied by its place, not by its arrival, and a row that comes again changes nothing, so any split
into micro-batches, any order and any restart from the checkpoint give what one ordered pass gives.

A session that is reset or taken over by another host starts a new generation. Its rows carry that number: a newer one
clears the state, an older one's rows are stale and are counted, not applied. Sessions without rows for `idle_ms` give their
state back by a timer and only keep their generation, so that late rows of it are counted as stale too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A log's entry, and where it is a summary what it says about itself.
ROW = "session_id string, generation long, seq long, entry_id string, is_summary boolean, append boolean, chain_start boolean, sequence long, first_covered string, last_covered string, first_kept string"
OUT = "session_id string, generation long, stale long, chain array<struct<seq:long,sequence:long>>"
META, PLACE = "generation long, closed boolean, stale long", "seq long, repeated boolean"
SEGMENT = ["seq", "append", "chain_start", "sequence", "first_covered", "last_covered", "first_kept"]
SEGMENTS = "seq long, append boolean, chain_start boolean, sequence long, first_covered string, last_covered string, first_kept string"
IDLE_MS = 24 * 3600 * 1000
STORE_KEY, EMPTY_KEY = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """A cell without pandas' signs for null; numbers, which a null in their column makes float, are whole."""
    if value is None or value is pd.NA or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) else value


class ActiveChain(StatefulProcessor):
    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", META)
        self.places = handle.getMapState("places", "entry_id string", PLACE)
        self.segments = handle.getListState("segments", SEGMENTS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, closed, stale = self.meta.get() if self.meta.exists() else (None, False, 0)
        kept = {s[0]: s for s in map(tuple, self.segments.get())} if self.segments.exists() else {}
        for part in rows:
            for r in part.to_dict("records"):
                r = {k: _plain(v) for k, v in r.items()}
                own = r["generation"] or 0
                if generation is not None and (own < generation or (own == generation and closed)):
                    stale += 1
                    continue
                if generation is None or own > generation:
                    generation, closed, kept = own, False, {}
                    self.places.clear()
                self._place(r["entry_id"], r["seq"])
                if r["is_summary"]:
                    kept[r["seq"]] = tuple(r[c] for c in SEGMENT)
        start = max((s[0] for s in kept.values() if s[1] and s[2]), default=None)
        ordered = sorted(s for s in kept.values() if start is None or s[0] >= start)
        self.segments.put(ordered) if ordered else self.segments.clear()
        self.meta.update((generation, closed, stale))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not closed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        chain = [] if closed or start is None else self._whole(ordered)
        yield pd.DataFrame({"session_id": [key[0]], "generation": [generation], "stale": [stale], "chain": [[{"seq": s[0], "sequence": s[3]} for s in chain]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, _, stale = self.meta.get()
        self.places.clear()
        self.segments.clear()
        self.meta.update((generation, True, stale))
        return iter(())

    def close(self) -> None:
        pass

    def _place(self, entry_id: str | None, seq: int) -> None:
        if entry_id is None:
            return
        known = self.places.getValue((entry_id,)) if self.places.containsKey((entry_id,)) else None
        if known is None:
            self.places.updateValue((entry_id,), (seq, False))
        elif known[0] != seq and not known[1]:
            self.places.updateValue((entry_id,), (known[0], True))

    def _at(self, entry_id: str | None) -> int | None:
        """The place of an id that the session holds once."""
        if entry_id is None or not self.places.containsKey((entry_id,)):
            return None
        seq, repeated = self.places.getValue((entry_id,))
        return None if repeated else seq

    def _whole(self, ordered: list[tuple]) -> list[tuple]:
        """The chain, or nothing where one segment has a defect."""
        before = None
        for nth, (_, append, _, sequence, first, last, kept) in enumerate(ordered, 1):
            at_first, at_last = self._at(first), self._at(last)
            if not append or sequence != nth or kept is None or at_first is None or at_last is None or at_first > at_last:
                return []
            if kept != "" and (self._at(kept) is None or self._at(kept) <= at_last):
                return []
            if before and before != first:
                return []
            before = kept
        return ordered


def live_chains(rows: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """session_id, generation, stale (rows dropped so far), chain (seq, sequence) of each session that a micro-batch touches.

    rows: a stream of the columns of ROW. Needs the RocksDB state store (use_state_store()).
    """
    return rows.groupBy("session_id").transformWithStateInPandas(ActiveChain(idle_ms), OUT, "Update", "ProcessingTime")


def use_state_store(spark: SparkSession, once: bool = False) -> None:
    """Settings of the session that live_chains needs; once: for a trigger that ends with the data at hand, as otherwise
    timers keep it running with empty batches. Timers then fire with the next data."""
    spark.conf.set(STORE_KEY, STORE)
    spark.conf.set(EMPTY_KEY, not once)


def chain_rows(latest: DataFrame) -> DataFrame:
    """session_id, seq, sequence: live_chains' newest row of each session as windows.active_chain gives it."""
    return latest.select("session_id", F.explode("chain").alias("x")).select("session_id", "x.seq", "x.sequence")
