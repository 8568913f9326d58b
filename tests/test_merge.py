"""The merger's and the watermark's scenarios, as tables, and their invariants."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowline.cdc import merge, offsets

ORDERS, USERS = "public.orders", "public.users"
#: place, table, pk, xid of a change; begin, end, low, estimated, high, xmin of chunks; where the snapshot completed; verdict.
FIRST = (0, 10, None, 1000, 1000, 900)
SCENARIOS = {
    "scanned, below xmin": ((20, ORDERS, 5, 850), [FIRST], None, "discard_stale"),
    "scanned, above xmin": ((20, ORDERS, 5, 950), [FIRST], None, "emit"),
    "scanned, at xmin": ((20, ORDERS, 5, 900), [FIRST], None, "emit"),
    "in progress, above": ((5, ORDERS, 5, 950), [FIRST], None, "emit"),
    "in progress, below": ((5, ORDERS, 5, 850), [FIRST], None, "discard_stale"),
    "not scanned": ((20, ORDERS, 2000, 950), [FIRST], None, "discard_unscanned"),
    "other table": ((20, USERS, 5, 950), [FIRST], None, "discard_unscanned"),
    "after completion": ((40, ORDERS, 2000, 1), [FIRST], 30, "emit"),
    "overflow waits": ((5, ORDERS, 51, 150), [(0, 10, None, None, 10, 100)], None, "buffer"),
    "overflow, later chunk drops": ((5, ORDERS, 51, 150), [(0, 10, None, None, 10, 100), (11, 20, 50, 60, 60, 200)], None, "discard_stale"),
    "overflow, later chunk emits": ((5, ORDERS, 51, 250), [(0, 10, None, None, 10, 100), (11, 20, 50, 60, 60, 200)], None, "emit"),
    "overflow, completion emits": ((5, ORDERS, 51, 150), [(0, 10, None, None, 10, 100)], 30, "emit"),
    "chunk still read": ((5, ORDERS, 5, 950), [(0, None, None, 1000, None, None)], None, "buffer"),
}
CHUNK = "table string, chunk_id long, begin long, end long, low long, estimated long, high long, xmin long"


@pytest.mark.parametrize("name", SCENARIOS)
def test_replay(spark, name):
    change, chunks, complete, verdict = SCENARIOS[name]
    changes = spark.createDataFrame([change], "place long, table string, pk long, xid long")
    spans = spark.createDataFrame([(ORDERS, i, *c) for i, c in enumerate(chunks)], CHUNK)
    assert [r["verdict"] for r in merge.replay(changes, spans, complete).collect()] == [verdict]


def test_restored_range_and_streaming(spark):
    scanned = spark.createDataFrame([(ORDERS, 0, None, 1000, 900)], "table string, chunk_id long, low long, high long, xmin long")
    changes = spark.createDataFrame([(ORDERS, 5, 850), (ORDERS, 6, 950), (ORDERS, 1001, 950), (ORDERS, None, 950)], "table string, pk long, xid long")
    judged = {r["pk"]: r["verdict"] for r in merge.verdicts(changes, scanned).collect()}
    assert judged == {5: "discard_stale", 6: "emit", 1001: "discard_unscanned", None: "discard_unscanned"}
    assert {r["verdict"] for r in merge.verdicts(changes, scanned, streaming=True).collect()} == {"emit"}


def test_settle_keeps_other_tables(spark):
    held = spark.createDataFrame([(ORDERS, 5, 950), (ORDERS, 5, 850), (ORDERS, 50, 950), (USERS, 5, 950)], "table string, pk long, xid long")
    emitted, carried = merge.settle(held, ORDERS, None, 10, 900)
    assert [tuple(r) for r in emitted.collect()] == [(ORDERS, 5, 950)]
    assert sorted(tuple(r) for r in carried.collect()) == [(ORDERS, 50, 950), (USERS, 5, 950)]


WATERMARK = [
    ([], {}, None), ([1, 2, 3], {}, None), ([2, 3], {1: 10}, 10), ([1, 2], {3: 30}, None),
    ([4], {1: 10, 2: 20, 3: 30}, 30), ([2], {1: 10, 3: 30}, 10), ([], {1: 10, 2: 20, 3: 30}, 30),
]


def _cursor(spark, pending, completed):
    chunks = [("t", i, 0, False) for i in pending] + [("t", i, hi, True) for i, hi in completed.items()]
    found = offsets.cursors(spark.createDataFrame(chunks, "table string, chunk_id long, hi long, complete boolean")).collect()
    return found[0]["cursor"] if found else None


@pytest.mark.parametrize("pending,completed,cursor", WATERMARK)
def test_watermark(spark, pending, completed, cursor):
    assert _cursor(spark, pending, completed) == cursor


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 20), st.booleans(), max_size=12))
def test_watermark_is_contiguous(spark, chunks):
    pending = [i for i, done in chunks.items() if not done]
    completed = {i: i * 10 + 9 for i, done in chunks.items() if done}
    expected = None
    for i in sorted(chunks):
        if not chunks[i]:
            break
        expected = completed[i]
    assert _cursor(spark, pending, completed) == expected


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 400), min_size=1, max_size=6), st.lists(st.tuples(st.integers(-5, 900), st.integers(0, 9)), min_size=1, max_size=20))
def test_verdicts_match_a_scan(spark, widths, changes):
    spans, low = [], None
    for i, w in enumerate(widths):
        high = (low or 0) + w
        spans.append(("t", i, low, high, i + 2))
        low = high
    df = spark.createDataFrame([("t", pk, xid, n) for n, (pk, xid) in enumerate(changes)], "table string, pk long, xid long, n int")
    got = {r["n"]: (r["chunk_id"], r["verdict"]) for r in merge.verdicts(df, spark.createDataFrame(spans, "table string, chunk_id long, low long, high long, xmin long")).collect()}
    for n, (pk, xid) in enumerate(changes):
        hit = next((s for s in spans if (s[2] is None or pk > s[2]) and pk <= s[3]), None)
        assert got[n] == ((None, "discard_unscanned") if hit is None else (hit[1], "emit" if xid >= hit[4] else "discard_stale"))


def test_apply_changes(spark):
    events = spark.createDataFrame([("t", 1, "READ", None, "a"), ("t", 1, "UPDATE", 5, "b"), ("t", 2, "READ", None, "c"), ("t", 2, "DELETE", 3, None), ("t", 3, "INSERT", 9, "d")], "table string, pk long, op string, lsn long, v string")
    assert sorted((r["pk"], r["v"]) for r in merge.apply(events).collect()) == [(1, "b"), (3, "d")]


def test_confirmed_lsn_ignores_reads(spark):
    acked = spark.createDataFrame([("READ", 99), ("INSERT", 7), ("DELETE", None)], "op string, lsn long")
    assert offsets.confirmed_lsn(acked, 3).first()[0] == 7
    assert offsets.confirmed_lsn(acked.where(F.lit(False)), 3).first()[0] == 3
