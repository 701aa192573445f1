"""Mixing sources to target weights by temperature (problem 9)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.cut import cut

#: Most sources of a mix; their sizes and targets (some 100 bytes each) are planned on the driver.
MAX_SOURCES = 1_000_000


def source_key(c: Column | str) -> Column:
    """Source names compare without outer blanks and case; blank is none."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.lower(F.trim(c))
    return F.when(name != "", name)


def temperature_weights(size: np.ndarray, base: np.ndarray, exponent: float) -> np.ndarray:
    """Weights proportional to ``base * (share / base) ** exponent``.

    Exponent 0 gives the base weights (targets, or equal weights), 1 the sources'
    own shares of the total size; between, the mix is tempered.
    """
    share = size / size.sum()
    logs = (1 - exponent) * np.log(base / base.sum()) + exponent * np.log(share)
    w = np.exp(logs - logs.max())
    return w / w.sum()


def bisect_exponent(fits, rounds: int = 60) -> float:
    """The smallest exponent in [0, 1] for which ``fits``, which holds at 1 if at all."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan_mix(
    size: np.ndarray, base: np.ndarray, repeats: np.ndarray, budget: float | None = None, entropy: float | None = None
) -> tuple[np.ndarray, float, float]:
    """Weights, exponent and budget of a mix (sizes, base weights and limits by source).

    Without a budget it is the largest at which the base weights keep every source
    within its repetition limit; then the exponent is 0 and targets are met. With a
    larger budget the exponent is bisected until the limits hold; beyond what the
    sources' own shares allow, the budget is cut to that. With ``entropy`` (bits)
    the exponent is bisected to the first mix of at most that entropy.
    """
    room = size * repeats
    largest = lambda a: float((room / temperature_weights(size, base, a)).min())
    exponent = 0.0
    if entropy is not None:
        def low_enough(a: float) -> bool:
            w = temperature_weights(size, base, a)
            return float(-(w * np.log2(w)).sum()) <= entropy

        exponent = bisect_exponent(low_enough)
    if budget is None:
        return temperature_weights(size, base, exponent), exponent, largest(exponent)
    if budget > largest(exponent):
        start = exponent
        exponent = start + (1 - start) * bisect_exponent(lambda a: largest(start + (1 - start) * a) >= budget)
    return temperature_weights(size, base, exponent), exponent, min(float(budget), largest(exponent))


def _wanted(targets: DataFrame) -> DataFrame:
    wanted = targets.select(source_key("source").alias("_key"), F.col("target_share").cast("double").alias("target_share"),
                            F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("max_repeats"))
    wanted = wanted.filter(F.col("_key").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    return wanted.groupBy("_key").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def available(items: DataFrame, source: Column, size: str, targets: DataFrame) -> float:
    """The largest budget that any mix of the sources' own shares and the targets can reach within the limits.

    It is reached at exponent 1, where weights are the sources' own shares: the total
    size times the smallest limit.
    """
    have = items.select(source_key(source).alias("_key"), F.col(size).alias("_n")).groupBy("_key").agg(F.sum("_n").alias("_n"))
    found = have.join(_wanted(targets), "_key").filter(F.col("_n") > 0).agg(F.sum("_n"), F.min("max_repeats")).first()
    return float((found[0] or 0) * (found[1] or 0))


def mix_sources(
    items: DataFrame, item: str, source: Column, size: str, targets: DataFrame, *, budget: float | None = None,
    entropy: float | None = None, seed: int = 13, block_items: int = 2_000,
) -> DataFrame:
    """A selection of items in which every source holds its target share of the size.

    ``targets``: ``source, target_share, max_repeats``; names compare by
    :func:`source_key`. Result, one row per chosen item: ``item, source, size,
    times, target_share, planned_share, reached_share, exponent`` (``times`` uses
    each). Sources without target, and targets of 0 or NULL, are not used; targets
    without items cannot be reached, and the others share their part in proportion
    (``planned_share``). Items of size 0 or NULL and NULL items are left out.

    A source's budget is spent in whole passes over all its items and one partial
    pass along a permutation: items fall into blocks by a hash of item and seed,
    blocks in number order and items in hash order within a block. The pass's end is
    found from block totals and then inside one block, so no source is gathered or
    sorted as a whole.
    """
    wanted = _wanted(targets)
    order = F.xxhash64(F.col("item"), F.lit(seed))
    rows = items.select(F.col(item).alias("item"), source_key(source).alias("_key"), F.col(size).cast("bigint").alias("size"))
    rows = cut(rows.filter(F.col("item").isNotNull() & (F.col("size") > 0)).withColumn("_order", order))
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).join(wanted, "_key").orderBy("_key").limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: one exponent is fitted for all of them on the driver")
    kind = items.schema[item].dataType.simpleString()
    spark = items.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"`{item}` {kind}, source string, size bigint, times int, target_share double, planned_share double, reached_share double, exponent double")
    total = np.array([r["total"] for r in sizes], float)
    base = np.array([r["target_share"] for r in sizes], float)
    limit = np.array([r["max_repeats"] for r in sizes], float)
    weights, exponent, spend = plan_mix(total, base, limit, budget, entropy)
    plan = []
    for r, w in zip(sizes, weights, strict=True):
        passes = min(int(spend * w // r["total"] + 1e-9), r["max_repeats"])
        left = 0.0 if passes == r["max_repeats"] else max(0.0, spend * w - passes * r["total"])
        plan.append((r["_key"], r["target_share"], float(w), passes, float(left), max(1, math.ceil(r["n"] / block_items))))
    # one row per source with a target
    plan_df = spark.createDataFrame(plan, "_key string, target_share double, planned_share double, passes int, left double, blocks int")
    rows = rows.join(F.broadcast(plan_df) if len(plan) <= 10_000 else plan_df, "_key")
    rows = rows.withColumn("_block", F.pmod(F.col("_order"), F.col("blocks")))
    blocks = rows.groupBy("_key", "_block").agg(F.sum("size").alias("_n"), F.first("left").alias("_left"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    edge = blocks.filter((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left"))).select("_key", F.col("_block").alias("_edge"), "_before")
    rows = rows.join(F.broadcast(edge) if len(plan) <= 10_000 else edge, "_key", "left")  # at most one row per source
    full = F.when(F.col("left") <= 0, False).when(F.col("_edge").isNull(), True).otherwise(F.col("_block") < F.col("_edge"))
    rows = rows.withColumn("_extra", F.when(full, 1).otherwise(0))
    within = Window.partitionBy("_key", "_block").orderBy("_order", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.filter(F.col("_edge").isNotNull() & (F.col("_block") == F.col("_edge")))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("size").over(within))
    # the item that crosses the end is used when that lands nearer to the budget
    inside = inside.withColumn("_extra", F.when(F.col("_upto") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).drop("_upto")
    outside = rows.filter(F.col("_edge").isNull() | (F.col("_block") != F.col("_edge")))
    chosen = outside.unionByName(inside).withColumn("times", (F.col("passes") + F.col("_extra")).cast("int")).filter(F.col("times") > 0)
    chosen = cut(chosen.select("item", "_key", "size", "times", "target_share", "planned_share"))
    used = chosen.groupBy("_key").agg(F.sum(F.col("size") * F.col("times")).alias("_used")).collect()
    whole = sum(r["_used"] for r in used)
    reached = spark.createDataFrame([(r["_key"], r["_used"] / whole) for r in used], "_key string, reached_share double")
    out = chosen.join(F.broadcast(reached) if len(used) <= 10_000 else reached, "_key").withColumn("exponent", F.lit(float(exponent)))
    return out.select(F.col("item").alias(item), F.col("_key").alias("source"), "size", "times", "target_share", "planned_share", "reached_share", "exponent")
