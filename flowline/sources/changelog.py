"""A Python streaming data source over a numbered message log, bounded by demand (SRC-1 to SRC-4, SRC-7, SRC-12, UDF-3, STR-1, STR-2).

The log is a folder of Parquet files with a whole-number column ``seq``, which every row has once.  Offsets are {"seq": next}.  A micro-batch takes at most
``budget`` rows (MaxDemand less MinDemand): its end is planned from an index of the row groups' statistics, which reads the footer of a
file once and only of files that it hasn't seen.  What has been delivered is decided by the stream's checkpoint alone, so a stopped query goes on
where it left off; a source that is to go on under a budget is told the ``checkpoint``, where the end of the last micro-batch that was planned is found.
A micro-batch may answer several open requests at once, as a producer is asked for the sum of all: each takes at most ``budget`` rows, in order of seq,
requests are numbered from 0 over micro-batches and restarts, and every row tells its own in a column ``request``.  Offsets then are {"seq": next, "request": next}.
Executors read the files themselves, so log and checkpoint are folders, named by URIs, that all of them see.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "flowline-log"
#: The column of the request that a row answers, where a micro-batch answers several.
REQUEST = "request"

#: Messages that are asked for where so few wait, and that may wait at most.
MIN_DEMAND, MAX_DEMAND = 10, 100


def demand(least: int = MIN_DEMAND, most: int = MAX_DEMAND) -> int:
    """Rows that one request asks for: what may wait less what is waiting when it is made."""
    if not 0 <= least < most:
        raise ValueError("demand needs 0 <= least < most")
    return most - least


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Span(InputPartition):
    """Rows with seq in [start, end), the files that may hold some, and the number of the first request that they answer."""

    def __init__(self, start: int, end: int, files: list[str], request: int = 0):
        super().__init__((start, end))
        self.start, self.end, self.files, self.request = start, end, files, request


class Index:
    """(first seq, last seq, rows, file, number) of every row group of the log, read once for each file."""

    def __init__(self, path: str):
        self.system, self.folder = located(path)
        self.seen: set[str] = set()
        self.groups: list[tuple[int, int, int, str, int]] = []

    def update(self) -> None:
        """Reads the footers of files that have come since; files without rows or that are being written are left out."""
        chosen = fs.FileSelector(self.folder, allow_not_found=True)
        for info in self.system.get_file_info(chosen):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet") or info.base_name[0] in "._" or info.path in self.seen:
                continue
            with self.system.open_input_file(info.path) as file:
                meta = pq.ParquetFile(file).metadata
            at = meta.schema.names.index("seq")
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                if group.num_rows:
                    stats = group.column(at).statistics
                    insort(self.groups, (stats.min, stats.max, group.num_rows, info.path, k))
            self.seen.add(info.path)

    def ends(self) -> tuple[int, int]:
        """First seq and the one after the last; (0, 0) for an empty log."""
        return (self.groups[0][0], max(g[1] for g in self.groups) + 1) if self.groups else (0, 0)

    def forget(self, start: int) -> None:
        """Drops what ends before ``start``, which a stream won't ask for again."""
        self.groups = [g for g in self.groups if g[1] >= start]

    def files(self, start: int, end: int) -> list[str]:
        return sorted({g[3] for g in self.groups if g[0] < end and g[1] >= start})

    def planned(self, start: int, budget: int) -> int:
        """The largest end up to which [start, end) has no more than ``budget`` rows; gaps in seq are free.

        Statistics give a bound on the rows before an end, which is exact for groups without gaps that don't overlap. Where the budget ends inside
        groups with gaps, their seqs are read, and only the first ones kept.
        """
        near = [g for g in self.groups if g[1] >= start]
        low = start
        for end in sorted({g[1] + 1 for g in near}):
            inside = list(takewhile(lambda g: g[0] < end, near))
            if sum(min(n, min(b, end - 1) - max(a, start) + 1) for a, b, n, *_ in inside) > budget:
                break
            low = end
        else:
            return low
        if all(b - a + 1 == n for a, b, n, *_ in inside) and all(x[1] < y[0] for x, y in zip(inside, inside[1:])):
            left = budget
            for a, b, *_ in inside:
                a = max(a, start)
                if b - a + 1 > left:
                    return max(low, a + left)
                left -= b - a + 1
        first = np.zeros(0, np.int64)
        for path in sorted({g[3] for g in inside}):
            with self.system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=["seq"], row_groups=[g[4] for g in inside if g[3] == path]):
                    seqs = batch.column(0).to_numpy()
                    first = np.concatenate([first, seqs[(seqs >= start) & (seqs < end)]])
                    if len(first) > 4 * budget + 4096:
                        first = np.partition(first, budget)[: budget + 1]
        first.sort()
        if len(first) > budget:
            return max(low, int(first[budget]))
        return end if len(first) == budget else self.planned(end, budget - len(first))

    def asked(self, start: int, end: int, budget: int, requests: int) -> int:
        """The least number of requests, ``requests`` at most, that take [start, end): all but the last one are full."""
        return bisect_left(range(1, requests), end, key=lambda n: self.planned(start, n * budget)) + 1


class _Log:
    """Reading a span of the log; the seq predicate reaches the Parquet row groups."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.names = schema.names
        self.parallel = max(1, int(options.get("parallel", 4)))
        self.budget = int(options["budget"]) if "budget" in options else None
        self.requests = int(options["requests"]) if "requests" in options else None
        self.checkpoint, self.source = options.get("checkpoint"), int(options.get("source", 0))
        if self.budget is not None and self.budget < 1:
            raise ValueError("the budget must be at least 1")
        if self.requests is not None and (self.requests < 1 or self.budget is None):
            raise ValueError("there must be at least one request, and a budget for each")
        if self.budget is not None and not self.checkpoint:
            raise ValueError("a stream under a budget can't go on unless the source is told its checkpoint")

    def spans(self, index: Index, start: int, end: int) -> list[Span]:
        n = min(self.parallel, max(1, end - start))
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        return [Span(a, b, files) for a, b in zip(cuts, cuts[1:]) if (files := index.files(a, b))]

    def answers(self, index: Index, start: dict, end: dict) -> list[Span]:
        """Spans of whole requests; the cuts depend on the rows of [start, end) alone, so a replay gives every row the same request."""
        low, number = start["seq"], start.get("request", 0)
        total = end["request"] - number
        n = min(self.parallel, total)
        firsts = [total * k // n for k in range(n)] if n > 0 else []
        cuts = [min(end["seq"], index.planned(low, f * self.budget)) if f else low for f in firsts] + [end["seq"]]
        return [Span(a, b, files, number + f) for a, b, f in zip(cuts, cuts[1:], firsts) if (files := index.files(a, b))]

    def batches(self, part: Span) -> Iterator:
        system, _ = located(self.path)
        wanted = (ds.field("seq") >= part.start) & (ds.field("seq") < part.end)
        log = ds.dataset(part.files, filesystem=system, format="parquet")
        if self.requests is None:
            yield from log.to_batches(columns=self.names, filter=wanted)
            return
        rows = log.to_table(columns=list(dict.fromkeys(["seq", *(n for n in self.names if n != REQUEST)])), filter=wanted).sort_by("seq")
        number = part.request + np.arange(len(rows), dtype=np.int64) // self.budget
        yield from rows.append_column(REQUEST, pa.array(number)).select(self.names).to_batches()


def planned_offset(checkpoint: str, source: int = 0) -> dict | None:
    """The end of the last micro-batch that a checkpoint has planned for its ``source``-th source; None before the first."""
    system, folder = located(checkpoint)
    found = system.get_file_info(fs.FileSelector(f"{folder}/offsets", allow_not_found=True))
    numbers = sorted((int(f.base_name) for f in found if f.base_name.isdigit()), reverse=True)
    if not numbers:
        return None
    with system.open_input_stream(f"{folder}/offsets/{numbers[0]}") as file:
        lines = file.read().decode().splitlines()
    offset = lines[2 + source]  # after the version and the batch's own facts
    return json.loads(offset) if offset != "-" else None


class LogReader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self) -> list[Span]:
        index = Index(self.log.path)
        index.update()
        return self.log.spans(index, *index.ends()) or [Span(0, 0, [])]

    def read(self, partition: Span) -> Iterator:
        return self.log.batches(partition) if partition.files else iter(())


class LogStreamReader(DataSourceStreamReader):
    """``commit`` needs no action, since the checkpoint holds what is done; ``at`` is the end that was planned last, and ``request`` the number of the next request."""

    def __init__(self, log: _Log):
        self.log, self.index, self.at, self.request = log, Index(log.path), None, 0

    def _offset(self, seq: int, request: int) -> dict:
        return {"seq": seq} if self.log.requests is None else {"seq": seq, "request": request}

    def initialOffset(self) -> dict:
        self.index.update()
        return self._offset(self.index.ends()[0], 0)

    def latestOffset(self) -> dict:
        self.index.update()
        first, last = self.index.ends()
        if self.log.budget is None:
            return {"seq": last}
        if self.at is None:  # a stream begins, or goes on where its checkpoint says
            planned = planned_offset(self.log.checkpoint, self.log.source) or self._offset(first, 0)
            self.at, self.request = planned["seq"], planned.get("request", 0)
        # a log that was empty at first begins wherever its first row is
        if last > self.at:
            self.index.forget(self.at)
            start, most = max(self.at, first), self.log.requests or 1
            self.at = self.index.planned(start, self.log.budget * most)
            self.request += most if self.at < last else self.index.asked(start, self.at, self.log.budget, most)
        return self._offset(self.at, self.request)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.index.update()
        if self.at is None or end["seq"] >= self.at:
            self.at, self.request = end["seq"], end.get("request", 0)
        if self.log.requests is not None:
            return self.log.answers(self.index, start, end)
        return self.log.spans(self.index, start["seq"], end["seq"])

    def read(self, partition: Span) -> Iterator:
        return self.log.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Options: path; parallel (tasks of a micro-batch, 4); budget (rows of a micro-batch, unbounded); requests (that a micro-batch answers at most, each with the budget; one, and untold); checkpoint and source (see :func:`planned_offset`)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the log's schema to the reader")

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(_Log(self.options, schema))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(_Log(self.options, schema))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and to the sessions cloned from it later."""
    spark.dataSource.register(LogSource)


def end_of(path: str) -> int:
    """The seq after the last one that the log has now."""
    index = Index(path)
    index.update()
    return index.ends()[1]
