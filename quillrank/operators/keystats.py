"""Per-key results where a few keys hold most rows (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_stats(
    df: DataFrame,
    key: str,
    member: str,
    time: str,
    distinct_rows: bool = True,
    names: tuple[str, str, str] = ("clicks", "users", "last_click"),
) -> DataFrame:
    """Rows, distinct members and latest time of every key, by map-side combining.

    Each map task folds its rows into a bounded hash table (which spills sorted
    runs when full) of mergeable states - count and maximum - and only those
    partial states are shuffled:

    1. exact copies collapse, hashed on the whole row, so no key is hot;
    2. states per (key, member), hashed on both;
    3. states per key: at most one partial row per key and map task, whatever the
       key's share of the input, and the exact member count is a plain count.

    A NULL key is a key of its own, a NULL member counts as a row but not as a
    member, a NULL time is ignored by the maximum; an empty input gives no rows.
    Columns of ``df`` other than those named matter only for what is a copy.
    """
    clicks, users, last = names
    rows = df.distinct() if distinct_rows else df
    rows = rows.select(F.col(key).alias("_key"), F.col(member).alias("_member"), F.col(time).alias("_time"))
    pairs = rows.groupBy("_key", "_member").agg(F.count(F.lit(1)).alias("_n"), F.max("_time").alias("_last"))
    return pairs.groupBy("_key").agg(
        F.sum("_n").alias(clicks), F.count("_member").alias(users), F.max("_last").alias(last)
    ).withColumnRenamed("_key", key)


def heavy_keys(stats: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """Keys, NULL left out, that hold at least ``share`` of all counted rows.

    ``stats`` is read twice: pass a written table when it is costly.
    """
    total = stats.agg(F.sum(count).alias("_total"))  # always exactly one row
    heavy = stats.filter(F.col(key).isNotNull()).join(F.broadcast(total), F.col(count) >= F.lit(share) * F.col("_total"))
    return heavy.drop("_total")
