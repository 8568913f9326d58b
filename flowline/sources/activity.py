"""Synthetic user activity (SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The actions that users take.
ACTIONS = ("login", "view_page", "click_button", "purchase", "logout")


def generate(spark: SparkSession, n: int, users: int = 10, seed: int = 42, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """``n`` messages (seq, user_id, action, ts, payload), one a second; the same seed gives the same rows at any parallelism.

    A page view's payload has ``page``, a purchase's ``product_id`` and ``amount``; other payloads are empty.
    """
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    actions = F.array(*map(F.lit, ACTIONS))
    action = F.element_at(actions, (draw(2, len(ACTIONS)) + 1).cast("int"))
    number = lambda salt, m: draw(salt, m).cast("string")
    payload = F.when(action == "view_page", F.create_map(F.lit("page"), F.concat(F.lit("/page/"), number(3, 100)))).when(action == "purchase", F.create_map(F.lit("product_id"), F.concat(F.lit("product-"), number(4, 100)), F.lit("amount"), (draw(5, 10000) / 100).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("user-"), draw(1, users).cast("string")).alias("user_id"), action.alias("action"), (F.to_timestamp(F.lit(start)) + F.make_interval(secs=F.col("id"))).alias("ts"), payload.alias("payload"))
