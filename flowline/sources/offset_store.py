"""Offset stores: one JSON state per slot, the last one saved holding (SNK-4, UDF-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "slot string, saved_at long, state string"


class OffsetStore:
    """States as small files, one for each saved version of a slot, on any file system that Spark reaches.

    A version is a file that is created or refused, never overwritten, so of two writers at once one gets the next version; ``load``
    takes the newest whole file, and ``compact`` keeps it alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, folder, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder, name)

    def _folder(self, slot: str):
        return self._at(self._root, "slot-" + slot.encode().hex())

    def _versions(self, folder, kind: str = ".json") -> list[int]:
        """Whole versions, oldest first; a file is whole once it has its final name."""
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(kind)) for n in names if n.endswith(kind) and n.removesuffix(kind).isdigit())

    def _text(self, folder, version: int) -> str:
        stream = self._files.open(self._at(folder, f"{version:020d}.json"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def save(self, slot: str, state: str) -> int:
        """Keeps ``state`` as the slot's next version, whose number is returned."""
        folder = self._folder(slot)
        while True:
            version = max([0, *self._versions(folder), *self._versions(folder, ".claim")]) + 1  # a writer that died leaves its number unused
            try:
                self._files.create(self._at(folder, f"{version:020d}.claim"), False).close()  # fails where another writer has it
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
                continue
            part = self._at(folder, f"{version:020d}.part")
            out = self._files.create(part, True)
            try:
                out.write(state.encode())
            finally:
                out.close()
            if self._files.rename(part, self._at(folder, f"{version:020d}.json")):
                return version

    def load(self, slot: str) -> str | None:
        folder = self._folder(slot)
        versions = self._versions(folder)
        return self._text(folder, versions[-1]) if versions else None

    def latest(self) -> DataFrame:
        """(slot, saved_at, state) of every slot; slots are few."""
        rows = []
        for f in self._files.listStatus(self._root) if self._files.exists(self._root) else []:
            if versions := self._versions(f.getPath()):
                rows.append((bytes.fromhex(f.getPath().getName()[5:]).decode(), versions[-1], self._text(f.getPath(), versions[-1])))
        return self.spark.createDataFrame(rows, SCHEMA)

    def compact(self, slot: str) -> None:
        """Removes all versions but the newest."""
        folder = self._folder(slot)
        for version in self._versions(folder)[:-1]:
            for kind in ("json", "claim"):
                self._files.delete(self._at(folder, f"{version:020d}.{kind}"), False)


#: A connector's state, as it is kept in JSON.
STATE = (
    "phase string, slot_name string, confirmed_lsn bigint, snapshot_tables array<struct<name:string,pk_column:string>>, current_snapshot_table string, "
    "snapshot_cursor bigint, scanned_pk_ranges array<struct<table:string,low:bigint,high:bigint,xmin:bigint>>"
)
