"""A streaming sink that acknowledges: files of the tasks that succeeded, listed by a manifest for each micro-batch (SNK-1, SNK-3, UDF-5, STR-9).

Each task writes a file of its own name and answers with the name and with how many rows of each status it holds. The commit puts these answers into one manifest, and
only what manifests list is ever read. So failed, repeated and speculative attempts leave no row behind, and nothing has to be renamed or replaced.
The first whole manifest of a micro-batch holds: a replay finds it, removes its own files and adds nothing. A manifest ends with the number of its files, so one that was
cut off counts as none and is written again.

Micro-batches are told apart by the stream's own id, which is in its checkpoint: a stream with a new checkpoint never takes another one's numbers for its own.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .changelog import located

NAME = "flowline-ledger"

#: Lines of a manifest: one for each file, then the end.
LINE = "file string, rows long, counts map<string,long>, files long"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: nothing if ``file`` is None."""

    file: str | None = None
    rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)


class LedgerWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, checkpoint: str, status: str | None):
        self.path, self.checkpoint, self.status = path, checkpoint, status

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One Arrow batch is held at a time; a task without rows makes no file."""
        system, folder = located(self.path)
        told, counts, out = Written(f"{uuid.uuid4().hex}.parquet"), Counter(), None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{folder}/data", recursive=True)
                    out = pq.ParquetWriter(f"{folder}/data/{told.file}", batch.schema, filesystem=system)
                out.write_batch(batch)
                told.rows += batch.num_rows
                if self.status is not None:
                    for pair in batch.column(batch.schema.names.index(self.status)).value_counts():
                        counts[pair["values"].as_py() or ""] += pair["counts"].as_py()
        finally:
            if out is not None:
                out.close()
        told.counts = dict(counts)
        return told if out is not None else Written()

    def _manifest(self, system: fs.FileSystem, folder: str, number: int) -> str:
        at, home = located(self.checkpoint)
        with at.open_input_stream(f"{home}/metadata") as file:
            stream = json.loads(file.read())["id"]
        system.create_dir(f"{folder}/manifests", recursive=True)
        return f"{folder}/manifests/{stream}-{number:012d}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, folder = located(self.path)
        name = self._manifest(system, folder, batchId)
        if whole(system, name):
            self.abort(messages, batchId)
            return
        files = [m for m in messages if m is not None and m.file is not None]
        lines = [{"file": m.file, "rows": m.rows, "counts": m.counts} for m in files] + [{"files": len(files)}]
        with system.open_output_stream(name) as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Removes what the tasks that answered have written; files of others are listed nowhere."""
        system, folder = located(self.path)
        for m in messages:
            if m is not None and m.file is not None:
                system.delete_file(f"{folder}/data/{m.file}")


def whole(system: fs.FileSystem, name: str) -> bool:
    """Whether a manifest is there to its end."""
    if system.get_file_info(name).type != fs.FileType.File:
        return False
    with system.open_input_stream(name) as file:
        lines = file.read().decode().split("\n")
    try:
        return lines[-1] == "" and len(lines) > 1 and json.loads(lines[-2]).get("files") == len(lines) - 2
    except ValueError:
        return False


class Ledger(DataSource):
    """Options: path; checkpoint, that of the query; status, the column whose values are counted (none if not given)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        missing = [o for o in ("path", "checkpoint") if not self.options.get(o)]
        if missing:
            raise ValueError(f"{NAME} needs the option {missing[0]}")
        return LedgerWriter(self.options["path"], self.options["checkpoint"], self.options.get("status"))


def start(stream: DataFrame, path: str, checkpoint: str, status: str | None = "status", interval: str | None = None) -> StreamingQuery:
    """Starts ``stream`` into the ledger at ``path``; without an interval it ends when the source is drained."""
    stream.sparkSession.dataSource.register(Ledger)
    writer = stream.writeStream.format(NAME).outputMode("append").option("checkpointLocation", checkpoint).option("checkpoint", checkpoint).option("path", path)
    writer = writer.option("status", status) if status is not None else writer
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def files(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, file, rows, counts) of everything that whole manifests list."""
    lines = spark.read.schema(LINE).json(f"{path.rstrip('/')}/manifests").withColumn("manifest", F.col("_metadata.file_name"))
    ended = lines.groupBy("manifest").agg(F.max("files").alias("_files"), F.count("file").alias("_n")).where("_files = _n").select("manifest")
    return lines.where("file is not null").join(ended, "manifest", "left_semi").select("manifest", "file", "rows", "counts")


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(status, n) of all that has been acknowledged, by the manifests alone."""
    return files(spark, path).select(F.explode("counts").alias("status", "n")).groupBy("status").agg(F.sum("n").alias("n"))


def rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all listed files; the driver holds the files' names, as for any table of files."""
    names = [f"{path.rstrip('/')}/data/{r['file']}" for r in files(spark, path).select("file").collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def swept(spark: SparkSession, path: str) -> int:
    """Removes data files that no manifest lists and says how many; to be called while no stream writes here."""
    known = {r["file"] for r in files(spark, path).select("file").collect()}
    system, folder = located(path)
    strays = [f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/data", allow_not_found=True)) if f.base_name not in known]
    for stray in strays:
        system.delete_file(stray)
    return len(strays)
