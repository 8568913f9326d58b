"""Streams with state over micro-batches, restarts, budgets and ends under load, against plain Python."""

import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from flowline.plans.storage import scratch
from flowline.sources import changelog
from flowline.streaming import merging, run as streaming, transactions, watermarks


@pytest.fixture(scope="module")
def own(spark):
    session = streaming.own_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def brute_merger(events):
    """{(table, place): (verdict, settled_at)} of a merger that keeps every range and buffer in lists."""
    out, state = {}, {}
    for place, kind, table, pk, xid, low, high, xmin in sorted(events, key=lambda e: e[0]):
        s = state.setdefault(table, {"ranges": [], "open": None, "waits": [], "over": False})
        inside = lambda k, lo, hi: k is not None and (lo is None or k > lo) and (hi is None or k <= hi)
        if kind == "change":
            found = next((r for r in s["ranges"] if inside(pk, r[0], r[1])), None)
            if s["over"]:
                out[table, place] = ("emit", place)
            elif found:
                out[table, place] = ("emit" if xid >= found[2] else "discard_stale", place)
            elif s["open"] and inside(pk, *s["open"]):
                s["waits"].append((place, pk, xid))
            else:
                out[table, place] = ("discard_unscanned", place)
        elif kind == "begin":
            s["open"] = (low, high)
        elif kind == "end" and s["open"]:
            span = (s["open"][0], high, xmin)
            s["ranges"].append(span)
            out.update({(table, p): ("emit" if x >= xmin else "discard_stale", place) for p, k, x in s["waits"] if inside(k, span[0], span[1])})
            s["waits"], s["open"] = [w for w in s["waits"] if not inside(w[1], span[0], span[1])], None
        elif kind == "complete":
            out.update({(table, p): ("emit", place) for p, *_ in s["waits"]})
            state[table] = {"ranges": [], "open": None, "waits": [], "over": True}
    return out | {(t, p): ("buffer", None) for t, s in state.items() for p, *_ in s["waits"]}


def interleaved(rng):
    """Chunks of two tables, one after the other, with changes between their begins and ends; keys beyond what a double holds."""
    base, events, place = 2**60, [], 0
    for table, chunks, over in (("a", 5, True), ("b", 3, False)):
        low = None
        for c in range(chunks):
            high = base + 100 * (c + 1) - rng.randrange(20)
            spots = [("begin", None, None, low, base + 100 * c + 130, None), *[None] * 25, ("end", None, None, low, high, 50 * (c // 2)), *[None] * 10]
            for spot in spots:
                if spot is None:
                    who = rng.choice("aab")
                    events.append((place, "change", who, rng.choice([None, *[base + rng.randrange(650)] * 30]), rng.randrange(150), None, None, None))
                else:
                    events.append((place, spot[0], table, *spot[1:]))
                place += 1
            low = high
        if over:
            events.append((place, "complete", table, None, None, None, None, None))
            place += 1
    return events


@pytest.mark.parametrize("cuts", [[], [2**60 + 150, 2**60 + 320]])
def test_merger_at_every_cut_and_after_restarts(spark, own, cuts):
    """The log comes in four parts, the stream is started anew for each: what has left it and what it holds are a plain merger's."""
    events = interleaved(random.Random(len(cuts)))
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    schema = "seq long, " + merging.EVENTS
    for k in range(4):
        part = [(e[0], *e) for e in events[k * len(events) // 4 : (k + 1) * len(events) // 4]]
        streaming.write_log(spark.createDataFrame(part, schema), path, 2)
        log = streaming.demanded(own, path, schema, 1000, checkpoint)
        query = streaming.sink(merging.merged(log.drop("seq"), cuts), out, checkpoint, interval="0 seconds")
        streaming.stopped(query, barrier=streaming.rows_barrier(path))
        settled = [tuple(r) for r in spark.read.parquet(out).select("table", "place", "verdict", "settled_at").collect()]
        waits = [tuple(r) for r in merging.waiting(own, checkpoint).select("table", "place", "verdict", "settled_at").collect()]
        want = brute_merger(events[: (k + 1) * len(events) // 4])
        assert sorted(settled + waits, key=repr) == sorted(((*at, *v) for at, v in want.items()), key=repr)
    held = merging.ranges(own, checkpoint).where("slice = 0").groupBy("table").count().collect()
    assert {r["table"]: r["count"] for r in held} == {"b": 2}  # three chunks, the first two of one xmin; none after completion


def test_transactions_over_restarts(spark, own):
    """Ends that come micro-batches later, aborts, transactions without an end, one of many rows, and nulls in what is held."""
    rng = random.Random(3)
    rows, place = [], 0
    left = {x: (5000 if x == 7 else rng.randrange(1, 9)) for x in range(30)}
    ends = {x: "abort" if x % 5 == 4 else None if x % 5 == 3 else "commit" for x in left}
    while left:
        x = rng.choice(list(left))
        for _ in range(min(left[x], 700)):
            rows.append((place, place, "change", x, None, rng.choice([None, 2**60 + place]), rng.choice([None, "é"])))
            place += 1
        left[x] -= min(left[x], 700)
        if not left[x]:
            del left[x]
            if ends[x]:
                rows.append((place, place, ends[x], x, place * 10, None, None))
                place += 1
    schema = "seq long, place long, kind string, xid long, lsn long, big long, word string"
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    for k in range(2):
        streaming.write_log(spark.createDataFrame(rows[k * len(rows) // 2 : (k + 1) * len(rows) // 2], schema), path, 2)
        log = streaming.demanded(own, path, schema, 1500, checkpoint)
        query = streaming.sink(transactions.assembled(log.drop("seq"), slices=3), out, checkpoint, interval="0 seconds")
        streaming.stopped(query, barrier=streaming.rows_barrier(path))
    lsn = {x: n for _, _, kind, x, n, _, _ in rows if kind == "commit"}
    got = [tuple(r) for r in spark.read.parquet(out).select("xid", "place", "big", "word", "commit_lsn", "batch_id").collect()]
    assert sorted((r[:5] for r in got), key=repr) == sorted(((x, p, big, word, lsn[x]) for _, p, kind, x, _, big, word in rows if kind == "change" and x in lsn), key=repr)
    batch = {}
    assert all(batch.setdefault(r[4], r[5]) == r[5] for r in got)  # whole, in one micro-batch
    assert [batch[c] for c in sorted(batch)] == sorted(batch.values())  # in the order of their commits
    held = {r["xid"]: r["n"] for r in transactions.held(own, checkpoint).groupBy("xid").agg(F.sum("n").alias("n")).collect()}
    assert held == {x: sum(r[3] == x and r[2] == "change" for r in rows) for x in ends if ends[x] is None}


def test_silent_transaction_goes(spark, own):
    """Rows of a transaction that never ends are given up after its time of silence."""
    schema = "seq long, place long, kind string, xid long, lsn long"
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    streaming.write_log(spark.createDataFrame([(0, 0, "change", 1, None), (1, 1, "change", 2, None)], schema), path, 1)
    log = streaming.demanded(own, path, schema, 10, checkpoint)
    query = streaming.sink(transactions.assembled(log.drop("seq"), silence_ms=1), out, checkpoint, interval="500 milliseconds")
    until = time.time() + 60
    while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 2):
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None and transactions.held(own, checkpoint).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_planned_offsets(seed):
    """No plan is above its budget, each goes as far as it may, and all rows are taken once; groups have gaps and overlap."""
    rng = random.Random(seed)
    index = changelog.Index.__new__(changelog.Index)
    seqs = sorted(rng.sample(range(400), 150)) if seed % 3 else list(range(150))
    if seed % 2:
        parts = [seqs[k : k + 30] for k in range(0, 150, 30)]
    else:
        parts = [sorted(p) for p in (seqs[:40] + seqs[45:60], seqs[40:45] + seqs[60:100], seqs[100:])]

    class Files:
        def open_input_file(self, path):
            import io

            import pyarrow as pa
            import pyarrow.parquet as pq

            held = io.BytesIO()
            pq.write_table(pa.table({"seq": parts[int(path)]}), held)
            return io.BytesIO(held.getvalue())

    index.system = Files()
    index.groups = sorted((p[0], p[-1], len(p), str(k), 0) for k, p in enumerate(parts))
    budget, at, taken = rng.choice([1, 7, 20, 1000]), seqs[0], []
    while at < seqs[-1] + 1:
        index.forget(at)
        end = index.planned(at, budget)
        batch = [s for s in seqs if at <= s < end]
        assert end > at and 0 < len(batch) <= budget
        taken += batch
        at = end
    assert taken == seqs


def test_budget_and_resume_in_the_backlog(spark):
    """Seqs with gaps: no micro-batch is above the budget, and a stream stopped in mid-backlog goes on; without its checkpoint it is refused."""
    changelog.register(spark)
    rng = random.Random(9)
    seqs = sorted(rng.sample(range(10_000), 3000))
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    streaming.write_log(spark.createDataFrame([(s,) for s in seqs], "seq long"), path, 3)
    ends = [lambda q: q.lastProgress is not None, lambda q: q.lastProgress is not None and q.lastProgress["batchId"] >= 3, streaming.rows_barrier(path)]
    for barrier in ends:
        query = streaming.sink(streaming.demanded(spark, path, "seq long", 400, checkpoint), out, checkpoint, interval="0 seconds")
        streaming.stopped(query, barrier=barrier)
    got = spark.read.parquet(out)
    assert sorted(r["seq"] for r in got.collect()) == seqs
    assert [r["count"] for r in got.groupBy("batch_id").count().orderBy("batch_id").collect()] == [400] * 7 + [200]
    streaming.write_log(spark.createDataFrame([(10_001,)], "seq long"), path, 1)
    untold = spark.readStream.format(changelog.NAME).schema("seq long").option("budget", 400).load(path)
    with pytest.raises(Exception, match="is told its checkpoint"):
        streaming.stopped(streaming.sink(untold, out, checkpoint, interval="0 seconds"), barrier=lambda q: False)


@pytest.mark.parametrize("kind", ["rows", "files"])
def test_end_under_steady_input(spark, kind):
    """Input goes on coming in every trigger; the stream ends all the same, with everything from before the barrier."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    local, over, written = path.removeprefix("file://"), threading.Event(), [0]
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    def append():
        at = written[0]
        pq.write_table(pa.table({"seq": list(range(at, at + 50))}), f"{local}/.{uuid.uuid4().hex}")
        newest = max((f"{local}/{f}" for f in os.listdir(local) if f[0] == "."), key=os.path.getmtime)
        os.rename(newest, f"{local}/part-{at:08d}.parquet")
        written[0] = at + 50

    os.makedirs(local)
    for _ in range(10):
        append()
    changelog.register(spark)
    stream = streaming.demanded(spark, path, "seq long", 100, checkpoint) if kind == "rows" else streaming.read_log(spark, path, "seq long", 2)
    query = streaming.sink(stream, out, checkpoint, interval="0 seconds")
    writer = threading.Thread(target=lambda: [(append(), time.sleep(0.1)) for _ in iter(over.is_set, True)])
    writer.start()
    try:
        time.sleep(2)
        before = written[0]
        barrier = streaming.rows_barrier(path) if kind == "rows" else streaming.files_barrier(path, checkpoint)
        began = time.time()
        stopping = threading.Thread(target=streaming.stopped, args=(query,), kwargs={"barrier": barrier})
        stopping.start()
        stopping.join(90)
        assert not stopping.is_alive() and time.time() - began < 90
        assert written[0] > before
    finally:
        over.set()
        writer.join()
        query.stop()
    got = sorted(r["seq"] for r in spark.read.parquet(out).collect())
    assert got == list(range(len(got))) and len(got) >= before


def test_idle_end_needs_no_barrier(spark):
    """Without a barrier a stream ends at a trigger without input that began after the call."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    streaming.write_log(spark.createDataFrame([(s,) for s in range(10)], "seq long"), path, 1)
    streaming.stopped(streaming.sink(streaming.read_log(spark, path, "seq long"), out, checkpoint, interval="100 milliseconds"))
    assert spark.read.parquet(out).count() == 10


def test_watermark_never_passes_a_gap(spark, own):
    """Acknowledgements in any order, some twice, some of several positions; the stream is started anew for each part, and is right after every one."""
    rng = random.Random(5)
    size, block, lanes = {"a": 300, "b": 40, "c": 7}, 16, 3
    acks = []
    for name, n in size.items():
        at = 0
        while at < n:
            high = min(n, at + rng.choice([1, 1, 2, 40]))
            acks += [(name, at, high)] * rng.choice([1, 1, 2])
            at = high
    rng.shuffle(acks)
    acks = [*acks[:5], (None, 0, 5), ("a", None, 3), ("a", 5, 5), ("a", -3, 4), ("d", 2**40, 2**40 + 1), *acks[5:]]
    marks = [(name, end, end * 10) for name, n in size.items() for end in range(7, n + 1, 7)]
    told = spark.createDataFrame(marks, "name string, end long, mark long")
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    seen = {}
    for k in range(4):
        part = acks[k * len(acks) // 4 : (k + 1) * len(acks) // 4]
        spark.createDataFrame(part, watermarks.ACKS).coalesce(2).write.mode("append").parquet(path)
        log = streaming.read_log(own, path, watermarks.ACKS)
        streaming.drained(streaming.sink(watermarks.tracked(log, block, lanes), out, checkpoint, mode="update"))
        for name, low, high in part:
            if name is not None and low is not None and low >= 0:
                seen.setdefault(name, set()).update(range(low, high))
        upto = {name: next(p for p in range(10**6) if p not in done) for name, done in seen.items()}
        want = {name: (u, max((m for n, e, m in marks if n == name and e <= u), default=None)) for name, u in upto.items()}
        for rows in (spark.read.parquet(out), watermarks.kept(own, checkpoint, block, lanes)):
            got = watermarks.safe(watermarks.reached(rows, block, lanes), told).collect()
            assert {r["name"]: (r["upto"], r["mark"]) for r in got} == want
    assert {n: upto[n] for n in size} == size  # all is acknowledged in the end
    state = own.read.format("statestore").option("stateVarName", "done").load(checkpoint)
    assert state.where("key.name = 'a'").count() == lanes  # and one stretch a lane is all that is left


def test_watermark_of_a_late_first_row(spark, own):
    """Lanes that have told nothing hold the watermark back, however much others have."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "out"), scratch(spark, "checkpoint")
    spark.createDataFrame([("t", 4, 5000)], watermarks.ACKS).write.parquet(path)
    streaming.drained(streaming.sink(watermarks.tracked(streaming.read_log(own, path, watermarks.ACKS), 4, 2), out, checkpoint, mode="update"))
    assert [tuple(r) for r in watermarks.reached(spark.read.parquet(out), 4, 2).collect()] == [("t", 0)]
