"""Streams with checkpointed progress: outcomes, keyed sessions, batches by size or time (STR-1 to STR-12, WIN-1 to WIN-3).

Sinks write each micro-batch to a folder of its own number and overwrite it on replay, so a replayed
micro-batch leaves no second copy.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.batching import Batcher, Handler, judged
from ..operators.outcomes import FAILED, OK
from ..operators.sessions import LOGIN, LOGOUT, PURCHASE, VIEW
from ..sources import changelog

#: Log files that a micro-batch takes at most: the backpressure.
FILES_PER_TRIGGER = 1
#: Rows that a micro-batch of a stream under a budget takes at most, however long its log: what a slice's task holds is bounded by it.
MOST_ROWS = 1_000_000
#: Groups of keys that share a state: as many calls of Python a micro-batch needs at most, however many keys it has.
BUCKETS = 4096
#: Rows of a file of the log at most.
FILE_ROWS = 250_000


def own_session(spark: SparkSession) -> SparkSession:
    """A clone of ``spark``'s session, with its settings and sources, in which state lives in RocksDB.

    Streams of state that is appended to, of maps and of timers need that store, and other streams of ``spark`` keep theirs.
    """
    changelog.register(spark)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def append_log(df: DataFrame, path: str, parts: int) -> None:
    """Writes messages (``seq`` from 0) to a log folder in ``parts`` appends, in order of seq."""
    last = df.agg(F.max("seq")).first()[0]
    for k in range(parts if last is not None else 0):
        low, high = (last + 1) * k // parts, (last + 1) * (k + 1) // parts
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema, files: int = FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def share(spark: SparkSession, path: str, batches: int, least: int = FILES_PER_TRIGGER) -> int:
    """Files of a micro-batch, ``least`` at least, with which all files that the log has now are read in ``batches`` micro-batches at most, however many there are.

    For streams whose state is touched as a whole by any part of the log, so that it isn't read and written more often as the log grows, and whose tasks hold no more for a longer micro-batch.
    """
    return max(least, -(-len(spark.read.parquet(path).inputFiles()) // batches))


def write_log(df: DataFrame, path: str, files: int = 4) -> None:
    """Appends messages to a log folder, in ``files`` ranges of seq, and each range in files of a bounded number of rows, so that what is read for a part of the log doesn't grow with it."""
    df.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def demanded(spark: SparkSession, path: str, schema, budget: int, checkpoint: str, requests: int | None = None) -> DataFrame:
    """The log as a stream whose micro-batches take at most ``budget`` rows, in order of seq; ``checkpoint`` is that of the query to be started.

    With ``requests``, a micro-batch answers so many open requests at most, each with ``budget`` rows at most, and rows have their number as ``request``.
    The session must know the source: see :func:`own_session` and ``changelog.register``.
    """
    reader = spark.readStream.format(changelog.NAME).option("budget", budget).option("checkpoint", checkpoint)
    if requests is None:
        return reader.schema(schema).load(path)
    return reader.schema(StructType([*schema.fields, StructField(changelog.REQUEST, LongType())])).option("requests", requests).load(path)


def sink(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Starts ``stream`` into ``path``; ``transform`` runs on every micro-batch.  Without an interval it ends when the source is drained."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    # a query takes its settings at its start; with batches without data, pending timeouts would keep it from ending
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def drained(query: StreamingQuery) -> None:
    """Waits until the source is drained, then stops: nothing fetched is lost, since offsets are committed after the sink."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def idle(*queries: StreamingQuery) -> bool:
    """Whether every query waits for data: nothing is there that it hasn't processed (AGG-9, STR-5)."""
    return all(not q.isActive or not (q.status["isDataAvailable"] or q.status["isTriggerActive"]) for q in queries)


Barrier = Callable[[StreamingQuery], bool]


def rows_barrier(path: str, source: int = 0) -> Barrier:
    """Reached when a stream of the log source has processed every row that the log at ``path`` has now."""
    end = changelog.end_of(path)

    def reached(query: StreamingQuery) -> bool:
        progress = query.lastProgress
        at = re.search(r"seq\W+([0-9]+)", str(progress["sources"][source]["endOffset"])) if progress else None
        return end == 0 or at is not None and int(at[1]) >= end

    return reached


def files_barrier(path: str, checkpoint: str, source: int = 0) -> Barrier:
    """Reached when a stream of the file source has processed every file that the folder at ``path`` has now, by the checkpoint's own logs."""
    system, folder = changelog.located(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    missing = {f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}
    held, home = changelog.located(checkpoint)
    read: set[str] = set()

    def names(at: str) -> list[str]:
        return [f.base_name for f in held.get_file_info(fs.FileSelector(f"{home}/{at}", allow_not_found=True)) if f.base_name[0] != "."]

    def reached(_: StreamingQuery) -> bool:
        done = max((int(n) for n in names("commits") if n.isdigit()), default=-1)
        for name in names(f"sources/{source}"):
            if name in read or not name.removesuffix(".compact").isdigit() or int(name.removesuffix(".compact")) > done:
                continue
            with held.open_input_stream(f"{home}/sources/{source}/{name}") as file:
                missing.difference_update(json.loads(line)["path"].rsplit("/", 1)[1] for line in file.read().decode().splitlines()[1:] if line)
            read.add(name)
        return not missing

    return reached


def stopped(*queries: StreamingQuery, barrier: Barrier | None = None) -> None:
    """Graceful end: each query processes all that was there when this was called, then stops (STR-6).

    The barrier says when that is so, and is taken before the call, so input that goes on coming doesn't keep a query running. Without one, a query
    ends at the first trigger without input that began since, for which an idle query takes ten seconds and steady input may take for ever.
    """
    called = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")

    def idle_since(q: StreamingQuery) -> bool:
        return q.lastProgress is not None and q.lastProgress["numInputRows"] == 0 and q.lastProgress["timestamp"] >= called

    for q in queries:
        while q.isActive and not (barrier or idle_since)(q):
            time.sleep(0.05)
        q.stop()
        if q.exception() is not None:
            raise q.exception()


def sessions(activity: DataFrame) -> DataFrame:
    """(user_id, session) after each micro-batch for the users it touches; state survives restarts in the checkpoint.

    A session is an aggregate of its user's rows, so the state is one row of sums and of what has the greatest seq, kept by Spark itself.
    """
    action, seq = F.col("action"), F.col("seq")
    flag = action.isin(LOGIN, LOGOUT)
    bought = F.when((action == PURCHASE) & ~F.isnan(F.col("amount").cast("double")), F.col("amount").cast("double"))
    return activity.groupBy("user_id").agg(
        F.coalesce(F.max_by(action == LOGIN, F.when(flag, seq)), F.lit(False)).alias("is_logged_in"), F.max("seq").cast("long").alias("last_seq"), F.max_by(F.col("ts").cast("timestamp_ntz"), "seq").alias("last_activity"),
        F.count_if(action == VIEW).alias("page_views"), F.count_if(action == PURCHASE).alias("purchase_count"), F.coalesce(F.sum(bought), F.lit(0.0)).alias("total_purchase_amount"),
    )


def _bucketed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("bucket", F.pmod(F.xxhash64("batcher", "batch_key"), F.lit(BUCKETS)).cast("int"))


def _due(state: GroupState, now: int, ends: Iterable[int]) -> None:
    """The state's timeout: the first of ``ends``."""
    first = min(ends, default=None)
    if first is not None:
        state.setTimeoutDuration(max(1, first - now))


def batches(messages: DataFrame, size: int, timeout_ms: int | None = None) -> DataFrame:
    """(batcher, batch_key, batch_no, n, lo, hi) as batches fill up, or, with a timeout, when an incomplete one has waited so long.

    State is the next number and fewer than ``size`` waiting seqs per key; keys share one by a hash, so a call of Python serves many.
    """

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if timeout_ms is None else state.getCurrentProcessingTimeMs()
        held = {(b, k): [n, t, list(w)] for b, k, n, t, w in zip(*state.get)} if state.exists else {}
        out, touched = [], set()
        for part in () if state.hasTimedOut else parts:
            for b, k, seq in zip(part["batcher"].tolist(), part["batch_key"].tolist(), part["seq"].tolist()):
                held.setdefault((b, k), [0, now, []])[2].append(seq)
                touched.add((b, k))
        for key, entry in held.items():
            number, since, waits = entry
            late = timeout_ms is not None and key not in touched and since + timeout_ms <= now
            if key not in touched and not (late and waits):
                continue
            waits.sort()
            whole = len(waits) if late else len(waits) - len(waits) % size
            for at in range(0, whole, size):
                part = waits[at : min(at + size, whole)]
                out.append((*key, number, len(part), part[0], part[-1]))
                number += 1
            entry[:] = number, now, waits[whole:]
        state.update(([b for b, _ in held], [k for _, k in held], *([e[i] for e in held.values()] for i in range(3))))
        if timeout_ms is not None:
            _due(state, now, (t + timeout_ms for _, t, waits in held.values() if waits))
        yield pd.DataFrame(out, columns=["batcher", "batch_key", "batch_no", "n", "lo", "hi"])

    schema = "batcher string, batch_key string, batch_no long, n long, lo long, hi long"
    kept = "batchers array<string>, batch_keys array<string>, numbers array<long>, since array<long>, waiting array<array<long>>"
    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _bucketed(messages.select("batcher", "batch_key", "seq")).groupBy("bucket").applyInPandasWithState(step, schema, kept, "append", timeout)


def _judged(texts: list[str], batcher: str, handlers: dict[str, Handler]) -> list[tuple]:
    if handlers.get(batcher) is None:
        return [(json.loads(t)["seq"], OK, None) for t in texts]
    rows = pd.DataFrame([json.loads(t) for t in texts])
    status, error = judged(rows, handlers.get(batcher))
    return list(zip(rows["seq"].tolist(), status, error))


def _outcomes(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"seq": pd.Series([o[0] for o in out], dtype="int64"), "status": pd.Series([o[1] for o in out], dtype=object), "error": pd.Series([o[2] for o in out], dtype=object)})


def handled(messages: DataFrame, batchers: Iterable[Batcher], handlers: dict[str, Handler]) -> DataFrame:
    """Outcomes (seq, status, error) of a stream's routed messages, batches reaching over micro-batches (WIN-2, STR-14).

    A batch is handed to its batcher's handler when it is full, or when its first message has waited for the batcher's timeout.
    Failed messages and those for unknown batchers get their outcome at once.  State is fewer than a batch of messages per key, as
    JSON, and keys share one by a hash; handlers get the messages' JSON values; within a micro-batch, messages are taken in order of seq.
    """
    config = {b.name: (b.batch_size, int(1000 * b.batch_timeout)) for b in batchers}

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {(b, k): (list(w), t) for b, k, w, t in zip(*state.get)} if state.exists else {}
        out, fresh = [], {}
        for part in () if state.hasTimedOut else parts:
            lost = part["message"].isna()
            out += [(s, FAILED, e) for s, e in zip(part["seq"][lost].tolist(), part["error"][lost].tolist())]
            part = part[~lost]
            for b, k, s, m in zip(part["batcher"].tolist(), part["batch_key"].tolist(), part["seq"].tolist(), part["message"].tolist()):
                fresh.setdefault((b, k), []).append((s, m))
        for key, found in fresh.items():
            size, (waits, since) = config[key[0]][0], held.get(key, ([], 0))
            before = len(waits)
            waits = waits + [m for _, m in sorted(found)]
            whole = len(waits) - len(waits) % size
            for at in range(0, whole, size):
                out += _judged(waits[at : at + size], key[0], handlers)
            held[key] = (waits[whole:], since if before and not whole else now)
        # a batcher that the stream was started without this time gives up what waits for it
        ends = {key: since + config.get(key[0], (0, 0))[1] for key, (_, since) in held.items()}
        for key in [k for k in held if ends[k] <= now and k not in fresh or not held[k][0]]:
            waits = held.pop(key)[0]
            out += _judged(waits, key[0], handlers) if waits else []
        if held:
            state.update(([b for b, _ in held], [k for _, k in held], [w for w, _ in held.values()], [t for _, t in held.values()]))
            _due(state, now, (ends[k] if k not in fresh else held[k][1] + config[k[0]][1] for k in held))
        elif state.exists:
            state.remove()
        yield _outcomes(out)

    known = F.coalesce(F.col("batcher").isin(*config), F.lit(False))
    unknown = F.coalesce("error", F.concat(F.lit("unknown batcher: "), F.coalesce("batcher", F.lit("None"))))
    message = F.when(known & F.col("error").isNull(), F.to_json(F.struct("*"))).alias("message")
    slim = messages.select("batcher", "batch_key", "seq", F.when(known, F.col("error")).otherwise(unknown).alias("error"), message)
    kept = "batchers array<string>, batch_keys array<string>, waits array<array<string>>, since array<long>"
    return _bucketed(slim).groupBy("bucket").applyInPandasWithState(step, "seq long, status string, error string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def flushed(spark: SparkSession, checkpoint: str, handlers: dict[str, Handler]) -> DataFrame:
    """Outcomes of what a stopped stream of :func:`handled` still held, by its batches' handlers, read from the state."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = [F.col(f"value.groupState.{name}") for name in ("batchers", "waits")]
    held = state.select(F.inline(F.arrays_zip(*kept)).alias("batcher", "waits")).where(F.size("waits") > 0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [o for batcher, texts in zip(part["batcher"], part["waits"]) for o in _judged(list(texts), batcher, handlers)]
            yield _outcomes(out)

    return held.mapInPandas(run, "seq long, status string, error string")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Batches that a stopped stream of :func:`batches` still held: the flush at shutdown, read from the state itself."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = [F.col(f"value.groupState.{name}") for name in ("batchers", "batch_keys", "numbers", "waiting")]
    held = state.select(F.inline(F.arrays_zip(*kept)).alias("batcher", "batch_key", "batch_no", "held")).where(F.size("held") > 0)
    return held.select("batcher", "batch_key", "batch_no", F.size("held").cast("long").alias("n"), F.array_min("held").alias("lo"), F.array_max("held").alias("hi"))
