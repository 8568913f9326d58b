"""Helpers that several operators use: shared storage, checked broadcasts, safe names."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: A table is broadcast up to this many measured bytes and rows; beyond either the join shuffles both sides.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1_000_000

#: Words are runs of anything but ASCII white space, as ``bytes.split()`` makes them.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Folders made where none is set, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a new local one only where it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        app = spark.sparkContext.applicationId
        set_dir = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="flowline-")
    return set_dir.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor.  They are removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; its folder goes with it
        return


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Put ``data`` in the shared folder and have every executor fetch it; returns the name for ``SparkFiles.get``.

    Executors that join later fetch it too.  The caller checks the size.
    """
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{name}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        out = system.create(target)
        try:
            out.write(data)
        finally:
            out.close()
    spark.sparkContext.addFile(target.toString())
    return name


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value: 8 for numbers, the length of texts, and that of the JSON form of nested values."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, and their bytes as measured, are within bounds; else as it is (the join then shuffles).

    At most ``most_rows`` + 1 rows are measured.  ``df`` is read twice, so it should be a written table or cheap.
    """
    bytes_ = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(8)).cast("bigint")
    n, total = df.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and total <= most_bytes else df


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over all rows before this one in ``order``, which has no ties.

    Rows are dealt to ranges of the order and summed there; the ranges' totals, a row for each partition, give what is
    added, so no task sees more than a range.
    """
    part = fresh(df, "part")
    dealt = materialise(df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(F.col(part).alias("_of")).agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select("_of", *[before(f"_t_{k}", Window.orderBy("_of")).alias(f"_t_{k}") for k in sums])
    inner = Window.partitionBy(part).orderBy(*order)
    local = dealt.withColumns({k: before(f"_{k}", inner) for k in sums}).join(F.broadcast(totals), F.col(part) == F.col("_of"))
    return local.withColumns({k: F.col(k) + F.col(f"_t_{k}") for k in sums}).drop(part, "_of", *[f"_{k}" for k in sums], *[f"_t_{k}" for k in sums])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_documents(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids``; rows without an id stay.  Columns are unchanged."""
    key = fresh(docs, "gone_id")
    gone = small(materialise(ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")


def word_count(text: Column) -> Column:
    """Number of words in ``text`` (null: 0), without Python."""
    pieces = F.split(text, WORD_GAP, -1)
    ends = (F.element_at(pieces, 1) == "").cast("long") + (F.element_at(pieces, -1) == "").cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(F.greatest(F.size(pieces).cast("long") - ends, F.lit(0).cast("long")))
