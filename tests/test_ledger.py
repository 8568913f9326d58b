"""The acknowledging sink: failed attempts, replays, cut-off manifests and several streams into one ledger."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowline.plans.storage import removed, scratch
from flowline.sources import ledger
from flowline.streaming import run as streaming

SCHEMA = "seq long, status string"


def part(seqs, status="ok"):
    return pa.record_batch({"seq": pa.array(seqs, pa.int64()), "status": pa.array([status] * len(seqs), pa.string())})


def writer(tmp_path, stream="one"):
    (tmp_path / f"checkpoint-{stream}").mkdir(exist_ok=True)
    (tmp_path / f"checkpoint-{stream}" / "metadata").write_text(f'{{"id":"{stream}"}}')
    return ledger.LedgerWriter(f"file://{tmp_path}/ledger", f"file://{tmp_path}/checkpoint-{stream}", "status")


def seqs(spark, tmp_path):
    return sorted(r["seq"] for r in ledger.rows(spark, f"file://{tmp_path}/ledger", SCHEMA).collect())


def counts(spark, tmp_path):
    return {r["status"]: r["n"] for r in ledger.acknowledged(spark, f"file://{tmp_path}/ledger").collect()}


def test_failed_attempts_and_replays(spark, tmp_path):
    """A task that dies half-way, one that succeeds twice, a batch without rows, an abort, and a batch that is committed again."""
    w = writer(tmp_path)

    def dying():
        yield part([0, 1])
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(dying())
    twice = [w.write(iter([part([0, 1]), part([2], "failed")])) for _ in range(2)]
    assert (twice[0].rows, twice[0].counts) == (3, {"ok": 2, "failed": 1})
    empty = w.write(iter([part([])]))
    assert empty.file is None
    w.commit([twice[0], None, empty], 0)  # the other attempt's answer is never asked for
    w.commit([], 1)
    w.abort([w.write(iter([part([9])])), None], 2)
    w.commit([w.write(iter([part([3])]))], 2)
    w.commit([w.write(iter([part([3])]))], 2)
    assert seqs(spark, tmp_path) == [0, 1, 2, 3] and counts(spark, tmp_path) == {"ok": 3, "failed": 1}
    assert ledger.swept(spark, f"file://{tmp_path}/ledger") == 2  # the dead task's file and the second attempt's
    assert seqs(spark, tmp_path) == [0, 1, 2, 3]


@pytest.mark.parametrize("keep", [0, 10, -1, -3])
def test_cut_off_manifest(spark, tmp_path, keep):
    """A manifest without its end counts as none, and the replay writes it whole."""
    w = writer(tmp_path)
    w.commit([w.write(iter([part([0])]))], 0)
    w.commit([w.write(iter([part([1])])), w.write(iter([part([2])]))], 1)
    torn = tmp_path / "ledger" / "manifests" / "one-000000000001.json"
    lines = torn.read_text().splitlines(keepends=True)
    torn.write_text({0: "", 10: lines[0][:10], -1: "".join(lines[:-1]), -3: lines[0] + lines[2][:-3]}[keep])
    assert seqs(spark, tmp_path) == [0]
    w.commit([w.write(iter([part([1, 2])]))], 1)
    assert seqs(spark, tmp_path) == [0, 1, 2]


def test_streams_of_their_own(spark, tmp_path):
    """Two streams, or one with a new checkpoint, have batches of equal numbers; both are kept. A null status is counted under an empty name."""
    for k, name in enumerate(("one", "two")):
        w = writer(tmp_path, name)
        w.commit([w.write(iter([part([k], None)]))], 0)
    assert seqs(spark, tmp_path) == [0, 1] and counts(spark, tmp_path) == {"": 2}


def test_replay_in_a_stream(spark):
    """The last batch's commit is lost after the manifest was written: the stream runs it again, and every message still has one outcome."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "ledger"), scratch(spark, "checkpoint")
    streaming.append_log(spark.range(40).select(F.col("id").alias("seq")), path, 4)
    stream = streaming.read_log(spark, path, "seq long").withColumn("status", F.when(F.col("seq") % 4 == 0, "failed").otherwise("ok"))
    streaming.drained(ledger.start(stream, out, checkpoint))
    removed(spark, f"{checkpoint}/commits/3")
    again = ledger.start(stream, out, checkpoint)
    streaming.drained(again)
    assert again.lastProgress["batchId"] == 3 and again.lastProgress["numInputRows"] == 10
    assert sorted(r["seq"] for r in ledger.rows(spark, out, SCHEMA).collect()) == list(range(40))
    assert {r["status"]: r["n"] for r in ledger.acknowledged(spark, out).collect()} == {"failed": 10, "ok": 30}
    assert ledger.swept(spark, out) == 0  # the replay removed its own files


def test_options_are_asked_for(spark):
    spark.dataSource.register(ledger.Ledger)
    stream = spark.readStream.format("rate").load()
    with pytest.raises(Exception, match="needs the option"):
        stream.writeStream.format(ledger.NAME).option("checkpointLocation", scratch(spark, "checkpoint")).option("path", scratch(spark, "x")).trigger(availableNow=True).start().awaitTermination()
