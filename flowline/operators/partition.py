"""Exchange by key: consistent-hash ring, affinity, distribution (EXC-1 to EXC-7, SORT-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import fnv1a32


def ring(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """(node, node_hash), one point per node; of nodes with equal hashes the first given stays."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "place int, node string")
    return rows.withColumn("node_hash", fnv1a32(F.col("node"))).groupBy("node_hash").agg(F.min_by("node", "place").alias("node")).select("node", "node_hash")


def owners(keys: DataFrame, nodes: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with ``owner``: the first node at or after the key's hash, wrapping to the first node; null without nodes.

    The ring is small (one row per worker), so it is one sorted array from a scalar subquery: no join, no window.
    """
    held = nodes.agg(F.array_sort(F.collect_list(F.struct("node_hash", "node"))))
    after = F.filter("_ring", lambda n: n["node_hash"] >= F.col("_hash"))
    owner = F.coalesce(F.get(after, 0)["node"], F.get(F.col("_ring"), 0)["node"])
    return keys.withColumns({"_hash": fnv1a32(F.col(key)), "_ring": held.scalar()}).withColumn("owner", owner).drop("_ring", "_hash")


def distribute(messages: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Deals messages to ``n`` partitions: evenly, or by key with each key's messages together and in order of ``seq``."""
    if n < 1:
        raise ValueError("at least one worker is needed")
    if key is None:
        return messages.repartition(n)
    return messages.repartition(n, key).sortWithinPartitions(key, "seq")


def total_demand(demands: DataFrame) -> DataFrame:
    """One row: the demand of all open requests (AGG-2), which is what a source is asked for."""
    return demands.agg(F.coalesce(F.sum("demand"), F.lit(0).cast("bigint")).alias("demand"))


def greedy(messages: DataFrame, demands: DataFrame) -> DataFrame:
    """``messages`` (numbered by ``place`` from 0) with the ``request`` that takes each: requests fill up in order of arrival.

    ``demands`` has request, arrival and demand.  Messages beyond all demand wait: their request is null.
    """
    running = F.sum("demand").over(Window.orderBy("arrival", "request").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = demands.withColumn("_end", running).withColumn("_start", F.col("_end") - F.col("demand"))
    held = spans.agg(F.array_sort(F.collect_list(F.struct("_start", "_end", "request"))))  # one for each worker
    taker = F.get(F.filter("_requests", lambda r: (r["_start"] <= F.col("place")) & (F.col("place") < r["_end"])), 0)["request"]
    return messages.withColumn("_requests", held.scalar()).withColumn("request", taker).drop("_requests")
