"""Joins against per-key statistics whose keys are unevenly frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_key_stats(
    rows: DataFrame,
    stats: DataFrame,
    key: str,
    weight: str,
    total: float,
    spread: Column,
    head_share: float = 1e-4,
) -> DataFrame:
    """Inner join of ``rows`` with one statistics row per ``key``, safe for hot keys.

    Keys that hold at least ``head_share`` of ``total`` (the sum of ``weight``) are
    at most ``1 / head_share`` in number, so broadcasting them has a proven bound.
    Their rows then skip the shuffle on ``key``: they are spread over all partitions
    by ``spread`` with a key that matches nothing. Only the other keys, each below
    ``head_share`` of the rows, meet in a shuffled join.
    """
    extra = [c for c in stats.columns if c != key]
    head = stats.filter(F.col(weight) >= F.lit(float(total) * head_share))
    head = head.select(F.col(key), F.struct(*extra).alias("_head"))
    tail = stats.filter(F.col(weight) < F.lit(float(total) * head_share))
    tail = tail.select(F.struct(F.lit(0).alias("h"), F.col(key).cast("string").alias("k")).alias("_k"), F.struct(*extra).alias("_tail"))
    marked = rows.join(F.broadcast(head), key, "left").withColumn(
        "_k",
        F.when(F.col("_head").isNull(), F.struct(F.lit(0).alias("h"), F.col(key).cast("string").alias("k"))).otherwise(
            F.struct(F.lit(1).alias("h"), spread.cast("string").alias("k"))
        ),
    )
    joined = marked.join(tail, "_k", "left").withColumn("_s", F.coalesce("_head", "_tail"))
    kept = [c for c in rows.columns if c not in extra]
    return joined.filter(F.col("_s").isNotNull()).select(*kept, *[F.col(f"_s.{c}").alias(c) for c in extra])
