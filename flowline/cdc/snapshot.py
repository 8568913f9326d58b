"""Snapshot scans by primary key (SCAN-1 to SCAN-4, WIN-7, AGG-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import canonical_uuid, in_range
from ..operators.numbering import ranked

CHUNK_SIZE = 1000


def chunks(rows: DataFrame, pk: str, table: str, size: int = CHUNK_SIZE) -> DataFrame:
    """(table, pk, chunk_id, row): rows in chunks of ``size`` by ascending key, chunk ids from 0 within the table.

    Keys are whole numbers, or UUIDs as text, which are kept in canonical form and in its order. Rows are dealt to ranges of the key by quantiles of a
    sample, so keys may be as sparse or as crowded as they like; numbers of rows are exact.
    """
    if size < 1:
        raise ValueError("the chunk size must be at least 1")
    text = dict(rows.dtypes)[pk] == "string"
    key = canonical_uuid(F.col(pk)) if text else F.col(pk).cast("bigint")
    keyed = rows.select(F.lit(table).alias("table"), key.alias("pk"), F.struct(*rows.columns).alias("row"))
    placed = ranked(keyed, ["table"], "pk", "_place")
    return placed.withColumn("chunk_id", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")


def plan(chunked: DataFrame) -> DataFrame:
    """(table, chunk_id, size, lo, hi) of each chunk."""
    return chunked.groupBy("table", "chunk_id").agg(F.count("*").alias("size"), F.min("pk").alias("lo"), F.max("pk").alias("hi"))


def ranges(chunk_plan: DataFrame, xmin: Column) -> DataFrame:
    """(table, chunk_id, low, high, xmin): what each chunk has scanned, (low, high], the first being open below.

    Each chunk tells the next one its end, so that no task sees all chunks of a table.
    """
    kind = dict(chunk_plan.dtypes)["hi"]
    own = F.struct(F.col("chunk_id").alias("chunk_id"), F.col("size").alias("size"), F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.lit(None).cast(kind).alias("before"))
    after = F.struct((F.col("chunk_id") + 1).alias("chunk_id"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi"), F.col("hi").alias("before"))
    told = chunk_plan.select("table", F.inline(F.array(own, after)))
    met = told.groupBy("table", "chunk_id").agg(*[F.max(c).alias(c) for c in ("size", "lo", "hi", "before")]).where(F.col("hi").isNotNull())
    return met.select("table", "chunk_id", F.col("before").alias("low"), F.col("hi").alias("high"), xmin.alias("xmin"))


def page(rows: DataFrame, pk: str, cursor: object | None, size: int = CHUNK_SIZE) -> DataFrame:
    """The next ``size`` rows after ``cursor`` by key; None starts at the first row, 0 being a key like any other.

    The predicate reaches the scan, and ordering with the limit keeps ``size`` rows per task.
    """
    after = rows if cursor is None else rows.where(F.col(pk) > F.lit(cursor))
    return after.orderBy(pk).limit(size)


def tables(scans: list[tuple[str, DataFrame, str]], size: int = CHUNK_SIZE, done: list[str] = (), cursor: tuple[str, int | str] | None = None) -> DataFrame:
    """(ordinal, table, pk, chunk_id) of several tables in turn; those in ``done`` are skipped, and ``cursor`` resumes one after a key, a canonical UUID where keys are UUIDs."""
    out = None
    for k, (name, rows, pk) in enumerate(scans):
        if name in done:
            continue
        key = canonical_uuid(F.col(pk)) if dict(rows.dtypes)[pk] == "string" else F.col(pk)
        rest = rows.where(key > F.lit(cursor[1])) if cursor and cursor[0] == name else rows
        one = chunks(rest.select(pk), pk, name, size).select(F.lit(k).alias("ordinal"), "table", "pk", "chunk_id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table is left to scan")
    return out


def covered(keys: DataFrame, scanned: DataFrame) -> DataFrame:
    """Every (key, range) of ``keys`` (pk) and a few ``scanned`` ranges (low, high) with whether the key is inside."""
    held = scanned.agg(F.collect_list(F.struct(*scanned.columns)))
    each = keys.withColumn("_range", F.explode(held.scalar())).select(*keys.columns, "_range.*")
    return each.withColumn("inside", in_range(F.col("pk"), F.col("low"), F.col("high")))
