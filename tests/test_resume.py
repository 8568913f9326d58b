"""Coalesced ranges and resuming from a saved state, against plain Python and an uninterrupted run."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from flowline.cdc import merge, offsets, resume, snapshot
from flowline.plans.storage import scratch
from flowline.sources.offset_store import OffsetStore

RANGES = "table string, chunk_id long, low long, high long, xmin long"


def spans(rng):
    """Disjoint ranges of two tables with gaps, repeated xmins, open ends and an empty one; keys beyond what a double holds."""
    out = []
    for table, n in (("a", 60), ("b", 9)):
        at, chunk = None, 0
        for k in range(n):
            high = (2**60 if at is None else at) + rng.randrange(1, 50)
            if rng.random() < 0.8:
                out.append((table, chunk, at, high if (table, k) != ("b", n - 1) else None, rng.choice([10, 20, 30])))
            at, chunk = high, chunk + 1
    return [*out, ("b", 99, 2**59, 2**59, 10)]


def brute(ranges, horizon):
    out = []
    for table, chunk, low, high, xmin in sorted((r for r in ranges if r[2] is None or r[3] is None or r[3] > r[2]), key=lambda r: (r[0], r[2] is not None, r[2] or 0)):
        level = xmin if horizon is None else max(xmin, horizon)
        if out and out[-1][0] == table and out[-1][3] == low and low is not None and out[-1][4] == level:
            out[-1] = (*out[-1][:3], high, level)
        else:
            out.append((table, chunk, low, high, level))
    return out


@pytest.mark.parametrize("seed,horizon", [(0, None), (1, 20), (2, 100)])
def test_coalesced(spark, seed, horizon):
    """One range for each run, and the same verdicts for every change that can still come."""
    rng = random.Random(seed)
    ranges = spans(rng)
    told = spark.createDataFrame(ranges, RANGES)
    kept = offsets.coalesced(told, horizon)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(brute(ranges, horizon), key=repr)
    log = [(rng.choice("abc"), 2**60 + rng.randrange(-5, 2000), rng.randrange(horizon or 0, 120), k) for k in range(400)]
    changes = spark.createDataFrame(log, "table string, pk long, xid long, n long")
    verdict = lambda by: {r["n"]: r["verdict"] for r in merge.verdicts(changes, by).collect()}
    assert verdict(kept) == verdict(told.where("low is null or high is null or high > low"))


def test_coalesced_of_nothing_and_of_texts(spark):
    assert offsets.coalesced(spark.createDataFrame([], RANGES)).count() == 0
    rows = [("t", 0, None, "3a", 1), ("t", 1, "3a", "5", 1), ("t", 2, "5", "9", 2)]
    got = offsets.coalesced(spark.createDataFrame(rows, RANGES.replace("low long, high long", "low string, high string"))).collect()
    assert sorted(map(tuple, got)) == [("t", 0, None, "5", 1), ("t", 2, "5", "9", 2)]


def uuid_of(k: int) -> str:
    return str(uuid.UUID(hashlib.md5(str(k).encode()).hexdigest()))


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("kill", [0, 1, 2, 4])
def test_killed_at_a_chunk(spark, kill, text):
    """Rows acknowledged before and rows scanned after are those of one uninterrupted run, for numbers and UUIDs; so are the ranges by which changes are judged."""
    keys = sorted(uuid_of(k) for k in range(20)) if text else [k * 2**40 for k in range(20)]
    kind = "string" if text else "long"
    other = spark.createDataFrame([(k,) for k in keys[:7]], f"id {kind}")
    rows = {"first": other, "second": spark.createDataFrame([(k.upper().replace("-", "") if text else k,) for k in keys], f"id {kind}"), "third": other}
    # four chunks of five rows; those before ``kill`` are acknowledged, the one after it was read too, but isn't
    cursor = keys[5 * kill - 1] if kill else None
    chunk = lambda c: ("second", c, None if c == 0 else keys[5 * c - 1], keys[5 * c + 4], 7)
    known = spark.createDataFrame([("first", 0, None, keys[6], 5), *[chunk(c) for c in range(min(kill + 1, 4))]], RANGES.replace("low long, high long", f"low {kind}, high {kind}"))
    root, names = scratch(spark, "store"), [(n, "id") for n in ("first", "second", "third")]
    resume.save(spark, root, "s", resume.Saved(names, confirmed_lsn=3, table="second", cursor=cursor, ranges=[known]))
    saved = resume.load(spark, root, "s")
    assert (saved.tables, saved.phase, saved.confirmed_lsn, saved.table, saved.cursor) == (names, "snapshot", 3, "second", cursor)
    (left,) = resume.rest(saved, rows, 5)
    assert sorted((r["table"], r["pk"]) for r in left.collect()) == sorted([("second", k) for k in keys[5 * kill :]] + [("third", k) for k in keys[:7]])
    spans = resume.scanned(saved, left, F.lit(50).cast("long"))
    changes = spark.createDataFrame([(t, k, x) for t in rows for k in keys for x in (6, 8, 60)], f"table string, pk {kind}, xid long")
    got = {(r["table"], r["pk"], r["xid"]): r["verdict"] for r in merge.verdicts(changes, spans).collect()}
    for (table, pk, xid), verdict in got.items():
        level = 5 if table == "first" else 7 if table == "second" and keys.index(pk) < 5 * kill else 50
        unscanned = table != "second" and pk > keys[6]
        assert verdict == ("discard_unscanned" if unscanned else "emit" if xid >= level else "discard_stale"), (table, pk, xid)
    assert len(got) == 180


def test_state_versions(spark):
    """The newest state holds; once streaming nothing is left to scan; ranges of older states go when asked; a state without ranges is no error."""
    root, tables = scratch(spark, "store"), [("t", "id")]
    rows = {"t": spark.createDataFrame([(1,), (2,)], "id long")}
    known = spark.createDataFrame([("t", 0, None, 1, 5), ("t", 1, 1, 2, 5)], RANGES)
    assert resume.load(spark, root, "s") is None
    resume.save(spark, root, "s", resume.Saved(tables))
    assert [r["pk"] for r in resume.rest(resume.load(spark, root, "s"), rows)[0].orderBy("pk").collect()] == [1, 2]
    for cursor in (1, 2):
        resume.save(spark, root, "s", resume.Saved(tables, table="t", cursor=cursor, ranges=[known]))
        (ranges,) = resume.load(spark, root, "s").ranges
        assert [tuple(r) for r in ranges.collect()] == [("t", 0, None, cursor, 5)]  # one range, cut at the cursor
    resume.compact(spark, root, "s")
    assert len(resume.load(spark, root, "s").ranges[0].collect()) == 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ranges-{b's'.hex()}")
    assert len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)) == 1
    resume.save(spark, root, "s", resume.Saved(tables, phase="streaming", table="t", cursor=2, ranges=[known]))
    done = resume.load(spark, root, "s")
    assert done.ranges == [] and resume.rest(done, rows) == [] and OffsetStore(spark, root).latest().count() == 1


def test_states_that_make_no_sense(spark):
    for bad in (dict(phase="x"), dict(table="u"), dict(tables=[("t", "id"), ("t", "id")])):
        with pytest.raises(ValueError):
            resume.Saved(**{"tables": [("t", "id")], **bad})
    with pytest.raises(ValueError, match="no rows"):
        resume.rest(resume.Saved([("t", "id")]), {})


def test_tables_resume_by_uuid(spark):
    keys = sorted(uuid_of(k) for k in range(9))
    rows = spark.createDataFrame([(k.upper(),) for k in keys], "id string")
    got = snapshot.tables([("t", rows, "id")], 3, cursor=("t", keys[3])).collect()
    assert sorted((r["pk"], r["chunk_id"]) for r in got) == [(k, i // 3) for i, k in enumerate(keys[4:])]
