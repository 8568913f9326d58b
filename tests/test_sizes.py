"""Queries on tables that are larger, or laid out otherwise, than the given ones."""

import random
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowline.llm import simhash
from flowline.llm.queries import ORACLE, QUERIES as OPERATORS
from flowline.operators import batching, process
from flowline.operators.batching import Batcher
from flowline.operators.sessions import LOGIN, LOGOUT, PURCHASE, VIEW
from flowline.plans.oracle import ORACLE as CORE_ORACLE
from flowline.plans.pipeline import Pipeline
from flowline.plans.queries import QUERIES
from flowline.plans.storage import removed, scratch
from flowline.sources import changelog
from flowline.streaming import run as streaming, transactions, watermarks

from .conftest import SF, same


def test_sparse_plan_beyond_64_bits(spark, tmp_path):
    """Outliers' keys times 4e12 pass 2^63 from order 2,305,844 on: the plan holds them all, in order, and is the SQL's below that."""
    keys = [*range(0, 1500), *range(2_304_999, 2_309_999, 250), 8_999_998, 8_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    most = (2**63 - 1) // (4 * 10**12)
    spread = lambda k: (min(k, most) * 4 * 10**12 + k - min(k, most)) if k % 1000 == 999 else k * 100_003 if k % 2 == 0 else -k * 7
    want = sorted(map(spread, keys))
    assert len(set(want)) == len(keys) and want[-1] == most * 4 * 10**12 + 8_999_999 - most < 2**63
    got = sorted(tuple(r) for r in QUERIES["chunk_plan_sparse"](spark, f"file://{tmp_path}").select("chunk_id", "size", "lo", "hi").collect())
    assert got == [(k, len(part), part[0], part[-1]) for k in range(len(want) // 1000 + 1) if (part := want[1000 * k : 1000 * k + 1000])]


def test_repair_is_its_sql_where_ties_are_closed(spark):
    """Equal rows of one turn may be numbered either way by the SQL; with one row number for both of its orders, every row agrees."""
    sql = ORACLE["op11_conversation_repair"]
    closed = sql.replace("  FROM c, range(", "  , row_number() OVER () AS rn FROM c, range(").replace("sha256(text)) AS i", "sha256(text), rn) AS i").replace("BY turn NULLS FIRST) AS seen", "BY turn NULLS FIRST, rn) AS seen")
    assert closed.count("rn") == sql.count("rn") + 3
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    same(OPERATORS["op11_conversation_repair"](spark, "/root/testdata/sf0.01"), con, closed)


def test_no_pair_of_labels_is_too_far_in_a_run(spark):
    """40 texts share an end of 36 bits; only the first and the last in its order are near, 39 places apart. Pairs are joined by labels, once for each."""
    rng = random.Random(8)
    fps = sorted(5 | (k << 36) for k in rng.sample(range(1 << 15), 40))
    vectors = [[rng.getrandbits(63) for _ in range(16)] for _ in fps]
    vectors[-1] = [v ^ 1 for v in vectors[0]]
    df = spark.createDataFrame([(k % 2, fp, i, i, vectors[i]) for k in range(2) for i, fp in enumerate(fps)], "family int, fp long, label long, id long, fps array<long>").repartition(3)
    for bits in (0, 3):
        found = simhash.linked(df, 2, 36, 16, bits, 16)
        assert {(r["u"], r["v"]) for r in found.collect()} == {(0, 39)} and found.count() == 2
    # all alike: one link less than there are labels, for 780 pairs
    entries = np.array([[fp, i, i, *[7] * 16] for i, fp in enumerate(fps)], np.uint64)
    assert len(simhash._bucket_links(entries, 0, 0, simhash.ball(1, 36), 2, 36, 64, 16)) == 39


def test_session_of_a_late_row(spark):
    """A row that comes in a later micro-batch than a greater seq of its user is counted, and decides nothing."""
    path, out, checkpoint = (scratch(spark, n) for n in ("log", "out", "checkpoint"))
    schema = "user_id long, seq long, action string, ts timestamp_ntz, amount double"
    at = [datetime(2024, 1, d) for d in (1, 2)]
    for rows in ([(1, 10, LOGIN, at[1], None), (2, 11, VIEW, at[1], None)], [(1, 5, LOGOUT, at[0], None), (1, 6, PURCHASE, at[0], 2.5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streaming.drained(streaming.sink(streaming.sessions(streaming.read_log(spark, path, schema)), out, checkpoint, mode="update"))
    got = [tuple(r) for r in spark.read.parquet(out).where("batch_id = 1").drop("batch_id").collect()]
    assert got == [(1, True, 10, at[1], 0, 1, 2.5)]


def test_watermark_state_grows_by_cells(spark):
    """Every other position of 6,000 is acknowledged: 3,000 stretches are few entries of the state, and all positions are one."""
    own = streaming.own_session(spark)
    path, out, checkpoint = (scratch(spark, n) for n in ("log", "out", "checkpoint"))
    for step, want in ((0, (1, 6)), (1, (6000, 1))):
        acks = spark.range(3000).select(F.lit("t").alias("name"), (F.col("id") * 2 + step).alias("low"), (F.col("id") * 2 + step + 1).alias("high"))
        acks.coalesce(1).write.mode("append").parquet(path)
        log = streaming.read_log(own, path, watermarks.ACKS)
        streaming.drained(streaming.sink(watermarks.tracked(log, 4096, 1), out, checkpoint, mode="update"))
        state = own.read.format("statestore").option("stateVarName", "done").load(checkpoint)
        kept = watermarks.kept(own, checkpoint, 4096, 1).first()
        assert (kept["missing"], state.count()) == want and kept["gaps"] == (2999 if step == 0 else 0)


def test_watermark_of_a_long_log_takes_few_micro_batches(spark, duck, monkeypatch):
    """F1: each micro-batch reads and writes the state, and a log of more files takes no more of them; the rows are the SQL's."""
    batches, drained = [], streaming.drained
    monkeypatch.setattr(streaming, "FILE_ROWS", 50)
    monkeypatch.setattr(streaming, "drained", lambda query: drained(query) or batches.append(query.lastProgress["batchId"] + 1))
    same(QUERIES["stream_watermark"](spark, SF), duck, CORE_ORACLE["stream_watermark"])
    assert len(batches) == 1 and 2 <= batches[0] <= 8


def test_watermark_entries_are_bits():
    """stretches of any kind are the same after they were packed, and an entry takes a bit for each place of its cell at most."""
    draw = np.random.default_rng(1)
    for span in (1, 1024, 5000, 100_000, 5_000_000, 2**40):
        for n in (0, 1, 2, 2500):
            low = draw.integers(0, span, n)
            want = watermarks.joined(low, low + draw.choice([1, 1, 1, 2, 40, 1024, 5000], n))
            entries = watermarks.packed(*want)
            assert all((count > 1) == (bits is not None) and len(bits or b"") <= watermarks.CELL // 8 for count, _, _, _, bits in entries.values())
            got = watermarks.unpacked(dict(reversed(entries.items())))
            assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_watermark_acknowledgements_are_gathered():
    """a batch of 10,000 acknowledgements is few rows of stateful Python, and says what it did."""
    draw = np.random.default_rng(2)
    name, lane, low = draw.choice(["a", "b"], 10_000), draw.integers(0, 3, 10_000).astype(np.int32), draw.integers(0, 5000, 10_000)
    high = low + draw.integers(1, 3, 10_000)
    batch = pa.RecordBatch.from_pydict({"name": name, "lane": lane, "low": low, "high": high})
    rows = pd.concat([b.to_pandas() for b in watermarks.gathered(iter([batch, batch.slice(0, 0)]))])
    assert len(rows) <= 6 * (1 + 5000 // 2 // watermarks.ROW)
    for (n, k), part in rows.groupby(["name", "lane"]):
        mine = (name == n) & (lane == k)
        assert all(np.array_equal(a, b) for a, b in zip(watermarks.joined(*watermarks.spread(part["stretches"])), watermarks.joined(low[mine], high[mine])))
    assert set(map(tuple, rows[["name", "lane"]].to_numpy())) == {(n, k) for n in "ab" for k in range(3)}


def test_merge_under_a_bounded_budget(spark, duck, monkeypatch):
    """However long the log, a micro-batch of the merger takes no more than its most; the verdicts are the same."""
    budgets, demanded = [], streaming.demanded
    monkeypatch.setattr(streaming, "MOST_ROWS", 250)
    monkeypatch.setattr(streaming, "demanded", lambda *a: budgets.append(a[3]) or demanded(*a))
    same(QUERIES["stream_merge"](spark, SF), duck, CORE_ORACLE["stream_merge"])
    assert budgets == [250]


def test_requests_share_a_micro_batch(spark):
    """micro-batches don't grow in number with the requests; each request has its budget of rows, over gaps, restarts and a replayed micro-batch."""
    changelog.register(spark)
    seqs = sorted(random.Random(4).sample(range(9000), 3000))
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    table = spark.createDataFrame([(s,) for s in seqs], "seq long")
    streaming.write_log(table.where(F.col("seq") < seqs[1000]), path, 3)
    for part, requests in ((None, 1), (table.where(F.col("seq") >= seqs[1000]), 10), (None, 10)):
        if part is not None:
            streaming.write_log(part, path, 2)
        elif requests > 1:
            removed(spark, f"{checkpoint}/commits/{spark.read.parquet(out).agg(F.max('batch_id')).first()[0]}")
        query = streaming.sink(streaming.demanded(spark, path, table.schema, 70, checkpoint, requests), out, checkpoint, interval="0 seconds")
        # the last one replays its batch, and is at the barrier when that is done
        streaming.stopped(query, barrier=streaming.rows_barrier(path) if requests > 1 else lambda q: q.lastProgress is not None)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("seq", "request", "batch_id").collect())
    assert [r[:2] for r in got] == [(s, k // 70) for k, s in enumerate(seqs)]
    assert len({r[2] for r in got}) < 20  # of 43 requests


def test_neighbouring_transactions_share_a_state(spark):
    """one state, and so one call of Python, for many transactions; only those that wait are in the store, and a silent one goes without its neighbours."""
    own = streaming.own_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [(p, p, "change", p // 4, None, None) for p in range(8000)] + [(8000 + x, 8000 + x, "commit", x, x * 10, None) for x in range(2000) if x % 100]
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    schema = "seq long, place long, kind string, xid long, lsn long, word string"
    streaming.write_log(spark.createDataFrame(rows, schema), path, 2)
    query = streaming.sink(transactions.assembled(streaming.demanded(own, path, schema, 6000, checkpoint).drop("seq")), out, checkpoint, interval="0 seconds")
    streaming.stopped(query, barrier=streaming.rows_barrier(path))
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("place", "xid", "commit_lsn").collect())
    assert got == [(p, p // 4, p // 4 * 10) for p in range(8000) if p // 4 % 100]
    assert {r["xid"]: r["n"] for r in transactions.held(own, checkpoint).collect()} == {x: 4 for x in range(0, 2000, 100)}
    states = own.read.format("statestore").option("stateVarName", "waits").load(checkpoint)
    assert states.count() == 2  # of 2,000 transactions


def test_batches_of_many_keys_share_states(spark, monkeypatch):
    """states, and so calls of Python, don't grow in number with the keys; a key's batches are cut as if it had its own."""
    monkeypatch.setattr(streaming, "BUCKETS", 3)
    rows = spark.range(900).select(F.col("id").alias("seq"), F.lit("b").alias("batcher"), F.pmod(F.hash("id"), F.lit(70)).cast("string").alias("batch_key"))
    log, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    streaming.append_log(rows, log, 3)
    streaming.drained(streaming.sink(streaming.batches(streaming.read_log(spark, log, rows.schema), 4), out, checkpoint))
    got = spark.read.parquet(out).drop("batch_id").unionByName(streaming.waiting(spark, checkpoint))
    want = batching.sizes(batching.assign(rows, 4)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.format("statestore").load(checkpoint).count() == 3


def test_pipeline_of_many_keys_shares_states(spark, monkeypatch):
    """the same of the pipeline's batches; each batch its handler gets is of one key, whole and in order, and every message has one outcome."""
    monkeypatch.setattr(streaming, "BUCKETS", 3)
    source = spark.range(900).select(F.col("id").alias("seq"), F.pmod(F.hash("id"), F.lit(70)).cast("string").alias("key"), F.when(F.col("id") % 5 == 0, "x").otherwise("b").alias("batcher"))

    def handler(batch):
        if batch["batch_key"].nunique() > 1 or len(batch) > 4 or not batch["seq"].is_monotonic_increasing:
            raise ValueError("not a batch")
        return batch[batch["seq"] != batch["seq"].max()] if len(batch) == 4 else batch

    config = Pipeline(
        seq=F.col("seq"), partition_by=F.col("key"), batcher=F.col("batcher"), batchers=(Batcher("b", 4, 3600.0),), handlers={"b": handler},
        processor=lambda m: process.map_columns(m, F.when(F.col("seq") % 7 == 0, F.lit("seventh"))),
    )
    log, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    streaming.append_log(source, log, 3)
    streaming.drained(config.start(streaming.read_log(spark, log, source.schema), out, checkpoint))
    assert spark.read.format("statestore").load(checkpoint).count() == 3
    config.flush(spark, out, checkpoint)
    want = config.outcomes(source).select("seq", "status", "error").collect()
    assert sorted(map(tuple, spark.read.parquet(out).select("seq", "status", "error").collect())) == sorted(map(tuple, want))
