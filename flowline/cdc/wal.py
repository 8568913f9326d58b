"""The change log: transactions, operations, relations (SRC-7 to SRC-11, CDC-6, JOIN-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

READ, INSERT, UPDATE, DELETE = "READ", "INSERT", "UPDATE", "DELETE"


def assemble(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changes of committed transactions with their ``commit_lsn``; others are dropped.  ``commits`` has one row per xid."""
    return changes.join(commits.select("xid", "commit_lsn"), "xid")


def related(changes: DataFrame, relations: DataFrame) -> DataFrame:
    """Changes with their relation's schema and table; changes of unknown relations are dropped.

    Of several definitions of a relation the last one before the change holds (``lsn``); definitions are few.
    """
    spans = relations.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct(F.col("lsn").alias("since"), "schema", "table"))).alias("_known"))
    last = F.element_at(F.filter("_known", lambda k: k["since"] <= F.col("lsn")), -1)
    return changes.join(F.broadcast(spans), "relation_id").where(F.exists("_known", lambda k: k["since"] <= F.col("lsn"))).withColumns({"schema": last["schema"], "table": last["table"]}).drop("_known")


def decode(changes: DataFrame) -> DataFrame:
    """Images by operation: an insert has ``after`` only, a delete ``before`` only, an update ``after`` and the old image if it was sent."""
    return changes.withColumns({"before": F.when(F.col("op").isin(UPDATE, DELETE), F.col("before")), "after": F.when(F.col("op").isin(READ, INSERT, UPDATE), F.col("after"))})


def only(changes: DataFrame, *operations: str) -> DataFrame:
    """Changes of the given operations (FLT-4)."""
    return changes.where(F.col("op").isin(*operations))


def operation_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def merged_image(before, after):
    """A row map after an update: keys that the new image omits (unchanged large values) keep the old image's values."""
    return F.map_concat(F.map_filter(before, lambda k, v: ~F.array_contains(F.map_keys(after), k)), after)
