"""Operators on small inputs: hashes, values, numbering, batches, pipelines, streams and stores."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowline.cdc import snapshot, wal
from flowline.functions import hashing, values
from flowline.operators import batching, envelope, outcomes, partition, process
from flowline.operators.batching import Batcher
from flowline.operators.numbering import numbered, ranked
from flowline.plans.pipeline import Pipeline
from flowline.sources import activity
from flowline.sources.offset_store import OffsetStore
from flowline.streaming import run as streaming


def fnv(key: str) -> int:
    h = 2166136261
    for b in key.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    keys = ["", "a", "user-1", "é", "日本", "x" * 300, None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.fnv1a32(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == {k: None if k is None else fnv(k) for k in keys}
    assert fnv("a") == 3826002220 and fnv("user-1") == 4115888500


def test_ring_wraps_and_is_total(spark):
    nodes = ["n1", "n2", "n3"]
    keys = [f"key-{i}" for i in range(200)]
    got = {r["key"]: r["owner"] for r in partition.owners(spark.createDataFrame([(k,) for k in keys], "key string"), partition.ring(spark, nodes)).collect()}
    points = sorted((fnv(n), n) for n in nodes)
    assert got == {k: next((n for h, n in points if h >= fnv(k)), points[0][1]) for k in keys}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_numbering_over_blocks(spark, block):
    df = spark.range(200).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"))
    got = {}
    for r in numbered(df, ["k"], "seq", "place", block).collect():
        got.setdefault(r["k"], []).append((r["seq"], r["place"]))
    for rows in got.values():
        assert [p for _, p in sorted(rows)] == list(range(len(rows)))


def test_explicit_default_key_is_overridden(spark):
    rows = spark.createDataFrame([(1, "u1", "default", ""), (2, "u2", "own", "b"), (3, None, None, None), (4, "", "default", None)], "id long, u string, k string, b string")
    routed = envelope.route(envelope.wrap(rows, F.col("id"), F.col("u"), F.col("b"), F.col("k"))).orderBy("seq").collect()
    assert [(r["batcher"], r["batch_key"]) for r in routed] == [("default", "u1"), ("b", "own"), ("default", "default"), ("default", "default")]


def test_text_decode(spark):
    cases = [(16, "t", "b", True), (16, "x", "b", False), (20, "12", "i", 12), (20, "1x", "s", "1x"), (1700, "1.5", "f", 1.5), (1184, "2024-01-01 10:00:00+02", "tz", None), (1184, "2024-01-01 10:00:00+05:30", "s", "2024-01-01 10:00:00+05:30"), (1082, "2024-02-03", "ts", None), (25, "t", "s", "t")]
    df = spark.createDataFrame([(i, o, t) for i, (o, t, *_) in enumerate(cases)], "n int, oid int, text string")
    for r in df.select("n", values.decode_text(F.col("text"), F.col("oid")).alias("d")).collect():
        _, _, field, value = cases[r["n"]]
        assert r["d"][field] is not None and (value is None or r["d"][field] == value)
        assert field == "s" or r["d"]["s"] is None


def test_batch_outcomes_cover_every_message(spark):
    source = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 10).alias("user"))

    def handler(batch: pd.DataFrame):
        if batch["batch_key"].iloc[0] == "3":
            raise RuntimeError("broken")
        return None if batch["batch_key"].iloc[0] == "4" else batch.head(2)

    config = Pipeline(seq=F.col("seq"), partition_by=F.col("user").cast("string"), processor=lambda m: process.map_columns(m, F.when(F.col("seq") < 50, F.lit("half"))), batchers=(Batcher(batch_size=10),), handlers={"default": handler})
    got = config.outcomes(source).collect()
    assert sorted(r["seq"] for r in got) == list(range(100))
    assert sum(r["status"] == "ok" for r in got) == 16
    assert sum(r["error"] == "half" for r in got) == 50


def test_defaults_are_checked():
    with pytest.raises(ValueError):
        Batcher(concurrency=0)
    with pytest.raises(ValueError):
        Pipeline(seq=None, batchers=(Batcher("a"), Batcher("a")))


def test_rows_map_isolates_errors(spark):
    m = envelope.wrap(spark.range(6), F.col("id")).select("seq", "batcher", "error")
    got = {r["seq"]: r for r in process.map_rows(m, lambda x: 1 / 0 if x["seq"] == 2 else {"batcher": "b"}).collect()}
    assert got[2]["error"].startswith("ZeroDivisionError") and got[2]["batcher"] is None
    assert all(got[i]["batcher"] == "b" and got[i]["error"] is None for i in (0, 1, 3, 4, 5))
    assert outcomes.counts(outcomes.of(process.map_rows(m, lambda x: None))).collect()[0]["n"] == 6


def test_keyset_pages_cover_the_table(spark):
    df = spark.createDataFrame([(i,) for i in (0, 3, 4, 9, 10, 11, 40)], "pk long")
    seen, cursor = [], None
    while page := [r["pk"] for r in snapshot.page(df, "pk", cursor, 3).collect()]:
        seen += page
        cursor = page[-1]
    assert seen == [0, 3, 4, 9, 10, 11, 40]


def test_unchanged_values_are_kept(spark):
    df = spark.sql("SELECT map('a', '1', 'big', 'x') AS before, map('a', cast(null AS string)) AS after")
    assert df.select(wal.merged_image(F.col("before"), F.col("after")).alias("m")).first()["m"] == {"a": None, "big": "x"}


def test_activity_is_reproducible(spark):
    a = sorted(map(str, activity.generate(spark, 50).collect()))
    assert a == sorted(map(str, activity.generate(spark, 50).repartition(7).collect()))
    assert a != sorted(map(str, activity.generate(spark, 50, seed=1).collect()))


def test_offset_store(spark, tmp_path):
    store = OffsetStore(spark, f"file://{tmp_path}/offsets")
    assert store.load("a") is None
    for slot, state in (("a", "1"), ("b", "x"), ("a", "2")):
        store.save(slot, state)
    assert (store.load("a"), store.load("b")) == ("2", "x")
    assert {r["slot"]: r["state"] for r in store.latest().collect()} == {"a": "2", "b": "x"}
    # another writer has claimed the next version and not finished: it is passed over, and its number is not used again
    store._files.create(store._at(store._folder("a"), f"{3:020d}.claim"), False).close()
    assert store.load("a") == "2" and store.save("a", "ü") == 4 and OffsetStore(spark, f"file://{tmp_path}/offsets").load("a") == "ü"
    store.compact("a")
    assert store.load("a") == "ü" and store._versions(store._folder("a")) == [4] and store.save("a", "5") == 5


def test_a_random_processor_gives_one_outcome_each(spark):
    source = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("kind"))
    config = Pipeline(seq=F.col("seq"), batcher=F.col("kind"), processor=lambda m: process.map_columns(m, F.when(F.rand() < 0.5, F.lit("bad luck"))), batchers=(Batcher("0"), Batcher("1")), handlers={"0": lambda b: b.head(7)})
    got = config.outcomes(source).collect()
    assert sorted(r["seq"] for r in got) == list(range(2000))
    assert {r["error"] for r in got} == {None, "bad luck", "unknown batcher: 2", "not returned by its batch"}


def test_batches_are_cut_whole(spark):
    """Batches that reach over Arrow batches come to the handler in one piece and in order."""
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.lit("b").alias("batcher"), (F.col("id") % 3).cast("string").alias("batch_key"), (F.col("id") % 3).alias("x"))
    seen = lambda b: b if len(b) == 100 and b["seq"].is_monotonic_increasing and b["batch_key"].nunique() == 1 else b.head(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = batching.handle(batching.assign(rows.where("seq < 4500"), 100), seen).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4500 and all(r["status"] == "ok" for r in got)


def test_rows_map_keeps_types(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 2**60 + 1, None)], "seq long, n long, error string")
    seen = {r["seq"]: r["n"] for r in process.map_rows(rows, lambda m: {"n": None if m["n"] is None else m["n"] + 1}).collect()}
    assert seen == {1: None, 2: 2**60 + 2}


def test_stream_batches_time_out_in_a_pipeline(spark, tmp_path):
    import time

    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = spark.range(13).select(F.col("id").alias("seq"))
    streaming.append_log(rows, log, 2)
    config = Pipeline(seq=F.col("seq"), batchers=(Batcher(batch_size=5, batch_timeout=0.5),), handlers={"default": lambda b: b[b["seq"] != 12]})
    query = config.start(streaming.read_log(spark, log, rows.schema), out, checkpoint, interval="200 milliseconds")
    got = []
    for _ in range(120):
        time.sleep(0.5)
        got = spark.read.schema("seq long, status string, error string, batch_id int").parquet(out).collect() if (tmp_path / "out").exists() else []
        if len(got) == 13:
            break
    streaming.stopped(query)
    assert sorted((r["seq"], r["status"]) for r in got) == [(i, "ok" if i < 12 else "failed") for i in range(13)]


def test_stream_stops_and_resumes(spark, tmp_path):
    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = spark.range(60).select(F.col("id").alias("seq"))
    config = Pipeline(seq=F.col("seq"), processor=lambda m: process.map_columns(m, F.when(F.col("seq") % 2 == 0, F.lit("even"))))
    streaming.append_log(rows.where("seq < 25"), log, 2)
    streaming.drained(config.start(streaming.read_log(spark, log, rows.schema), out, checkpoint))
    assert spark.read.parquet(out).count() == 25
    rows.where("seq >= 25").coalesce(1).write.mode("append").parquet(log)
    streaming.drained(config.start(streaming.read_log(spark, log, rows.schema), out, checkpoint))
    got = [r["seq"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(60))


def test_batches_flush_in_a_stream(spark, tmp_path):
    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = spark.range(47).select(F.col("id").alias("seq"), F.lit("default").alias("batcher"), (F.col("id") % 2).cast("string").alias("batch_key"))
    streaming.append_log(rows, log, 3)
    streaming.drained(streaming.sink(streaming.batches(streaming.read_log(spark, log, rows.schema), 5), out, checkpoint))
    got = spark.read.parquet(out).drop("batch_id").unionByName(streaming.waiting(spark, checkpoint))
    expected = batching.sizes(batching.assign(rows, 5)).select("batcher", "batch_key", "batch_no", "n", "lo", "hi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_incomplete_batches_time_out(spark, tmp_path):
    """A batch that doesn't fill up is handed on after its timeout."""
    import time

    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = spark.range(3).select(F.col("id").alias("seq"), F.lit("default").alias("batcher"), F.lit("k").alias("batch_key"))
    streaming.append_log(rows, log, 1)
    query = streaming.sink(streaming.batches(streaming.read_log(spark, log, rows.schema), 5, timeout_ms=500), out, checkpoint, interval="200 milliseconds")
    got = []
    for _ in range(120):
        time.sleep(0.5)
        got = spark.read.schema("batcher string, batch_key string, batch_no long, n long, lo long, hi long, batch_id int").option("ignoreMissingFiles", True).parquet(out).collect() if (tmp_path / "out").exists() else []
        if got:
            break
    streaming.stopped(query)
    assert [(r["batch_no"], r["n"], r["lo"], r["hi"]) for r in got] == [(0, 3, 0, 2)]


def test_idle_and_stopped(spark, tmp_path):
    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = spark.range(9).select(F.col("id").alias("seq"))
    streaming.append_log(rows, log, 3)
    query = streaming.sink(streaming.read_log(spark, log, rows.schema), out, checkpoint, interval="100 milliseconds")
    streaming.stopped(query)
    assert streaming.idle(query) and not query.isActive
    assert spark.read.parquet(out).count() == 9


def test_sparse_keys_fill_tasks_evenly(spark):
    """Keys 100,000 apart, and such that half of them lie in a thousandth of the space: no range holds over twice the median, and numbers are exact."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for key in (F.col("id") * 100_000, F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 4_000_000_007)):
            rows = spark.range(200_000).select(key.alias("id"))
            placed = ranked(rows.withColumn("table", F.lit("t")), ["table"], "id", "place")
            files = {}
            for r in placed.select("id", "place").orderBy("id").collect():
                assert r["place"] == len(files)
                files[r["id"]] = r["place"]
            sizes = sorted(r["count"] for r in rows.repartitionByRange("id").groupBy(F.spark_partition_id()).count().collect())
            assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        chunked = snapshot.chunks(rows, "id", "t", 1000)
        assert [r["size"] for r in snapshot.plan(chunked).collect()] == [1000] * 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
