"""Row numbers within keys that no single key can overload, and an interval join without nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.storage import scratch

#: Order values that one block spans.
BLOCK = 1 << 16


def numbered(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... by the whole number ``order`` within ``keys``.

    A key's rows are cut into blocks of its order values, which are numbered by themselves; the blocks' sizes,
    one row each, give what is added.  So a key with a third of all rows is spread over many tasks, where its order values are dense enough for blocks
    to hold many; for sparse ones see :func:`ranked`.
    Rows of equal order are numbered in any order; ``order`` isn't null.
    """
    cut = "_block"
    blocked = df.withColumn(cut, F.expr(f"`{order}` div {block}"))
    sizes = blocked.groupBy(*keys, cut).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(cut).alias("_cut"), before.alias("_before"))
    same = F.col(cut) == F.col("_cut")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = F.row_number().over(Window.partitionBy(*keys, cut).orderBy(order)) - 1
    joined = blocked.withColumn("_local", local).join(sizes, same)
    return joined.withColumn(name, F.col("_before") + F.col("_local")).drop(cut, "_cut", "_before", "_local", "_n", *[f"_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The same for an order of any type, such as a UUID's text: rows are dealt to ranges of (keys, order), numbered there, and the ranges' sizes are added.

    Ranges are written once, so that both passes see the same ones.
    """
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_part"), before.alias("_before"))
    same = F.col("_range") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    joined = dealt.withColumn("_local", local).join(sizes, same)
    return joined.withColumn(name, F.col("_before") + F.col("_local")).select(*df.columns, name)


#: Widths of intervals are told apart by powers of this power of two.
STEP = 4


def _level(low: Column, high: Column) -> Column:
    """Least power of 2 ** STEP that is at least as wide as the interval, as a power of two; 64 if a bound is open."""
    width = (high - low).cast("double")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, F.lit(1.0)))).cast("int"))
    return F.when(low.isNull() | high.isNull(), F.lit(64)).otherwise(F.least(F.lit(60), (F.ceil(bits / STEP) * STEP).cast("int")))


def interval_lookup(events: DataFrame, ranges: DataFrame, equal: str, point: str, low: str, high: str, carry: list[str], place: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``events`` with the columns ``carry`` of the range (low, high] of the same ``equal`` that holds ``point``; null where none does.

    Ranges of one ``equal`` are disjoint.  ``place`` maps points to whole numbers in the same order, as texts need it.  An interval is
    hung on the one or two cells that it meets, of its own width's class, so each class that occurs (at most 16) is one
    equi-join instead of a comparison of every event with every range.  Open ranges are the first and last of their ``equal``,
    two of each at most, and are broadcast.
    """
    leveled = ranges.withColumn("_level", _level(place(F.col(low)), place(F.col(high))))
    out = events.withColumns({c: F.lit(None).cast(dict(ranges.dtypes)[c]) for c in carry})
    for level in sorted(r[0] for r in leveled.select("_level").distinct().collect()):
        cell = (lambda c: F.lit(0).cast("bigint")) if level == 64 else (lambda c, level=level: F.shiftright(place(c), level))
        cells = F.array(F.lit(0).cast("bigint")) if level == 64 else F.sequence(cell(F.col(low)), cell(F.col(high)))
        hung = leveled.where(F.col("_level") == level).where(f"({high} > {low}) or {low} is null or {high} is null").select(
            F.col(equal).alias("_equal"), F.col(low).alias("_low"), F.col(high).alias("_high"), *[F.col(c).alias(f"_{c}") for c in carry], F.explode(cells).alias("_cell"),
        )
        inside = (F.col("_low").isNull() | (F.col(point) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(point) <= F.col("_high")))
        joined = out.join(F.broadcast(hung) if level == 64 else hung, (F.col(equal) == F.col("_equal")) & (cell(F.col(point)) == F.col("_cell")) & inside, "left")
        out = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in carry}).drop("_equal", "_low", "_high", "_cell", *[f"_{c}" for c in carry])
    return out
