"""Chains as state, generations and the sink that counts every batch once: replays against the batch query."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.operators import windows
from logloom.streaming import chains, sinks

NAMES = [c.split()[0] for c in chains.ROW.split(", ")]


def row(session, seq, entry_id, generation=0, summary=None):
    append, start, sequence, first, last, kept = summary or (None,) * 6
    return (session, generation, seq, entry_id, summary is not None, append, start, sequence, first, last, kept)


def log(seed):
    """A session's rows: entries, summaries that append or start anew, and now and then a defect."""
    rng, rows, seq, chain = random.Random(seed), [], 0, []
    name = f"s{seed}"
    for _ in range(rng.randrange(2, 7)):
        first = seq
        for _ in range(rng.randrange(1, 4)):
            rows.append(row(name, seq, "twice" if rng.random() < 0.05 else f"e{seq}"))
            seq += 1
        start = not chain or rng.random() < 0.2
        chain = [] if start else chain
        covered = chain[-1] if chain and chain[-1] else f"e{first}"
        kept = rng.choice(["", f"e{seq + 1}"])
        nth = len(chain) + 1 + (rng.random() < 0.05)
        rows.append(row(name, seq, f"c{seq}", 0, (rng.random() > 0.05, start, nth, covered, f"e{seq - 1}", kept)))
        chain = [*chain, kept]
        seq += 1
    return [*rows, row(name, seq, f"e{seq}"), row(name, seq + 1, None)]


def batch_chains(spark, rows):
    df = spark.createDataFrame(rows, chains.ROW)
    found = windows.active_chain(df.where("is_summary"), df.select("session_id", "seq", "entry_id"))
    return sorted(tuple(r) for r in found.select("session_id", "seq", "sequence").collect())


def replay(spark, folder, drops, idle_ms=chains.IDLE_MS):
    """Each drop of rows is a file and a run of its own, restarted from the checkpoint; the newest row of each session."""
    chains.use_state_store(spark, once=True)
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, chains.ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(chains.ROW).parquet(f"{folder}/in")
        query = chains.live_chains(stream, idle_ms).writeStream.outputMode("update").foreachBatch(sinks.upsert_batch(f"{folder}/out", ["session_id"]))
        query = query.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(120), k
    return sinks.latest(spark, f"{folder}/out", ["session_id"])


def chains_of(latest):
    return sorted(tuple(r) for r in chains.chain_rows(latest).collect())


def test_replays_give_the_batch_query(spark, tmp_path):
    rows = [r for seed in range(40) for r in log(seed)]
    want = batch_chains(spark, rows)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    ordered = [[r for rs in by.values() for r in rs[k * len(rs) // 3 : (k + 1) * len(rs) // 3]] for k in range(3)]
    assert chains_of(replay(spark, str(tmp_path / "ordered"), ordered)) == want and len({s for s, *_ in want}) > 10
    # Out of order, with rows that come twice and rows of an older generation before and after.
    old = [(r[0], -1, *r[2:3], "twice", *r[4:]) for r in rows]
    shuffled = rows + rng_sample(rows, 60)
    random.Random(1).shuffle(shuffled)
    latest = replay(spark, str(tmp_path / "shuffled"), [old[:100] + shuffled[:200], shuffled[200:] + old[100:]])
    assert chains_of(latest) == want
    stale = sum(r.stale for r in latest.collect())
    assert len(old[100:]) <= stale <= len(old)


def rng_sample(rows, n):
    return random.Random(2).sample(rows, n)


def test_a_new_generation_and_idle_sessions(spark, tmp_path):
    first = [row("a", 0, "e0"), row("a", 1, "c1", 0, (True, True, 1, "e0", "e0", "")), row("b", 0, "e0"), row("b", 1, "c1", 0, (True, True, 1, "e0", "e0", ""))]
    later = [row("a", 0, "x0", 1), row("a", 1, "y1", 1, (True, True, 1, "x0", "x0", ""))]
    late = [row("a", 2, "z", 0), row("b", 2, "late")]
    folder = str(tmp_path / "g")
    assert chains_of(replay(spark, folder, [first, later], idle_ms=1)) == [("a", 1, 1), ("b", 1, 1)]
    got = {r.session_id: r for r in replay(spark, folder, [late], idle_ms=1).collect()}
    assert got["a"].stale == 1 and got["a"].generation == 1 and got["b"].stale == 1 and got["b"].chain == []  # b was idle: closed, its state given back


@pytest.mark.parametrize("fail", [False, True])
def test_each_batch_counts_once(spark, tmp_path, monkeypatch, fail):
    folder, run = str(tmp_path / "t"), sinks.upsert_batch(str(tmp_path / "t"), ["k"])
    of = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    assert sinks.latest(spark, folder, ["k"]) is None
    run(of((1, "a"), (2, "b")), 0)
    if fail:  # rows written, mark not: readers don't see them, a rerun replaces them
        with monkeypatch.context() as m:
            m.setattr(sinks, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                run(of((2, "half"), (9, "half")), 1)
        assert {(r.k, r.v) for r in sinks.latest(spark, folder, ["k"]).collect()} == {(1, "a"), (2, "b")}
    run(of((2, "c"), (3, "d")), 1)
    run(of((2, "again"), (7, "again")), 1)  # a second run of a committed batch
    want = {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.k, r.v) for r in sinks.latest(spark, folder, ["k"]).collect()} == want
    sinks.fold(spark, folder, ["k"])
    sinks.drop_folded(spark, folder)
    run(of((2, "again"),), 0)
    assert {(r.k, r.v) for r in sinks.latest(spark, folder, ["k"]).collect()} == want
    run(of((1, "z"),), 2)
    assert {(r.k, r.v) for r in sinks.latest(spark, folder, ["k"]).where(F.col("k") < 3).collect()} == {(1, "z"), (2, "c")}
