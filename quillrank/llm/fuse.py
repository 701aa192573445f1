"""One ranking from several differently-scaled scores by Borda count (problem 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.cut import cut
from quillrank.sources.raw import surrogate_ids

#: Lists longer than this are ranked by distributed counting instead of one window.
LONG_LIST = 200_000
#: Candidates of one list that are compared in one task.
CHUNK = 1_000


def _clean(rows: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per group and item; NaN as NULL, of repeated rows the highest scores."""
    numbers = [F.max(F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double"))).alias(s) for s in scores]
    return rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*numbers)


def _points_by_window(rows: DataFrame, group: str, scores: list[str], missing: str) -> DataFrame:
    whole = Window.partitionBy(group)
    out = rows.withColumn("_m", F.count(F.lit(1)).over(whole))
    for s in scores:
        by_score = whole.orderBy(F.col(s).asc_nulls_first())
        below = F.rank().over(by_score) - 1
        upto = F.count(F.lit(1)).over(by_score.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tied = upto - below
        if missing == "lowest":
            points = below + (tied - 1) / 2
        else:
            nulls = F.count_if(F.col(s).isNull()).over(whole)
            # absent scores neither win nor lose: they stand in the middle of the list
            scale = (F.col("_m") - 1) / F.greatest(F.col("_m") - nulls - 1, F.lit(1))
            single = (F.col("_m") - nulls) == 1
            points = F.when(F.col(s).isNull() | single, (F.col("_m") - 1) / 2).otherwise((below - nulls + (tied - 1) / 2) * scale)
        out = out.withColumn(f"_p_{s}", points.cast("double"))
    return out


def _points_by_counting(rows: DataFrame, group: str, item: str, scores: list[str], missing: str) -> DataFrame:
    """The same points for long lists, without gathering a list in one task.

    For each score the distinct values of a list are counted (map-side combined),
    put into ranges and counted per range; ranks are the prefix sum over ranges
    plus the prefix sum inside a range, and return to the rows by a join on value.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_m"), *[F.count_if(F.col(s).isNull()).alias(f"_z_{s}") for s in scores])
    out = rows.join(sizes, group)
    for s in scores:
        counted = rows.filter(F.col(s).isNotNull()).groupBy(group, s).agg(F.count(F.lit(1)).alias("_c"))
        grid = counted.agg(F.percentile_approx(s, [i / 256 for i in range(1, 256)], F.lit(2000))).first()[0] or []
        cuts = F.array(*[F.lit(float(x)) for x in sorted(set(grid))])
        counted = counted.withColumn("_r", F.size(F.filter(cuts, lambda x: x < F.col(s))) if grid else F.lit(0))
        ranges = counted.groupBy(group, "_r").agg(F.sum("_c").alias("_n"))
        before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(group, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(group, "_r").orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(ranges, [group, "_r"])
        placed = placed.select(group, F.col(s), (F.col("_before") + F.col("_in") + (F.col("_c") - 1) / 2).alias("_at"))
        out = out.join(placed, [group, s], "left")
        m, z = F.col("_m"), F.col(f"_z_{s}")
        if missing == "lowest":
            points = F.when(F.col(s).isNull(), (z - 1) / 2).otherwise(z + F.col("_at"))
        else:
            points = F.when(F.col(s).isNull() | ((m - z) == 1), (m - 1) / 2).otherwise(F.col("_at") * (m - 1) / F.greatest(m - z - 1, F.lit(1)))
        out = out.withColumn(f"_p_{s}", points.cast("double")).drop("_at")
    return out.drop(*[f"_z_{s}" for s in scores])


def borda(
    rows: DataFrame, group: str, item: str, scores: list[str], *, weights: list[float] | None = None,
    missing: str = "middle", long_list: int = LONG_LIST,
) -> DataFrame:
    """One order of every group's items from several scores, by places and not by values.

    A score gives an item one point for each item of the group that it is strictly
    above and half a point for each that it ties with (competition ranks, ties
    averaged). NULL and NaN get the middle place (``missing="middle"``; the others
    share the full range) or count as the lowest value, tied
    (``missing="lowest"``). Weighted points are summed and ranked from 1, ties by
    item. Result: ``group, item, scores, borda_points, list_size, borda_rank``.

    Rows repeated unchanged count once (of differing ones the highest value of each
    score); rows with a NULL group or item are left out; a list of one gets 0
    points. All windows share one partitioning, hence one shuffle. Lists above
    ``long_list`` rows take an equal path that counts instead of gathering.
    """
    return _borda(cut(_clean(rows, group, item, scores)), group, item, scores, weights, missing, long_list)


def _borda(
    clean: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None, missing: str, long_list: int
) -> DataFrame:
    weights = weights or [1.0] * len(scores)
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"_p_{s}") for w, s in zip(weights, scores, strict=True)])

    def pointed(points: DataFrame) -> DataFrame:
        return points.select(group, item, *scores, F.round(total, 9).alias("borda_points"), F.col("_m").alias("list_size"))

    by_points = Window.partitionBy(group).orderBy(F.desc("borda_points"), item)
    sizes = cut(clean.groupBy(group).count().filter(F.col("count") > long_list).select(group))
    if not sizes.limit(1).count():
        return pointed(_points_by_window(clean, group, scores, missing)).withColumn("borda_rank", F.row_number().over(by_points))
    # long lists are as many as rows / long_list at most
    short, long = clean.join(sizes, group, "left_anti"), clean.join(sizes, group, "left_semi")
    ranked = pointed(_points_by_window(short, group, scores, missing)).withColumn("borda_rank", F.row_number().over(by_points))
    return ranked.unionByName(_ranked_by_counting(pointed(_points_by_counting(long, group, item, scores, missing)), group, item))


def _ranked_by_counting(pointed: DataFrame, group: str, item: str) -> DataFrame:
    """``borda_rank`` of long lists: numbers of all rows in order, less that of their list's first; no list meets in one task."""
    falling = cut(pointed.withColumn("_falling", -F.col("borda_points")))
    numbered = cut(surrogate_ids(falling, [group, "_falling", item], "_no"))
    first = numbered.groupBy(group).agg(F.min("_no").alias("_first"))
    out = numbered.join(F.broadcast(cut(first)), group).withColumn("borda_rank", (F.col("_no") - F.col("_first") + 1).cast("int"))
    return out.select(*pointed.columns, "borda_rank")


def _beats(a: str, b: str, scores: list[str], majority: int):
    def wins(x, y):
        one = [F.when(x[s].isNotNull() & (y[s].isNull() | (x[s] > y[s])), 1).otherwise(0) for s in scores]
        return reduce(lambda p, q: p + q, one) >= majority

    return wins(a, b)


def _scan(found: str, scores: list[str], majority: int):
    """Fold an array of candidates to the only one that can beat all others.

    Whoever is beaten is out; if neither of two beats the other, both are out.
    """
    def step(best, x):
        return (
            F.when(best.isNull() | _beats(x, best, scores, majority), x)
            .when(_beats(best, x, scores, majority), best)
        )

    return lambda items, kind: F.aggregate(items, F.lit(None).cast(kind), step)


def outright_winners(
    rows: DataFrame, group: str, item: str, scores: list[str], *, min_list: int = 2, long_list: int = LONG_LIST
) -> DataFrame:
    """Per group the item that against every other is strictly higher on most scores.

    The order comes from :func:`borda` with missing values lowest: an item that
    wins most scores against each of ``m - 1`` others has at least
    ``majority * (m - 1)`` points, so all others are left out before any comparison.
    The remaining candidates are folded in chunks to one per group (an item once
    beaten is out), and that one is checked against its whole list: comparisons
    grow with the rows, not with their pairs. Groups without such an item give no row.
    """
    majority = len(scores) // 2 + 1
    # points are monotone in the number of wins, so the limit is exact up to rounding
    clean = cut(_clean(rows, group, item, scores))
    ranked = _borda(clean, group, item, scores, None, "lowest", long_list).filter(F.col("list_size") >= min_list)
    limit = F.lit(float(majority)) * (F.col("list_size") - 1) - 1e-6
    packed = F.struct(*[F.col(s) for s in scores], F.col(item), F.col("borda_rank"))
    candidates = ranked.filter(F.col("borda_points") >= limit).select(group, packed.alias("_c"), F.floor((F.col("borda_rank") - 1) / CHUNK).alias("_chunk"))
    kind = candidates.schema["_c"].dataType.simpleString()
    fold = _scan("_c", scores, majority)
    in_order = lambda c: F.array_sort(F.collect_list(c), lambda x, y: (x["borda_rank"] - y["borda_rank"]).cast("int"))
    part = candidates.groupBy(group, "_chunk").agg(in_order("_c").alias("_cs")).select(group, fold(F.col("_cs"), kind).alias("_c"))
    best = part.filter(F.col("_c").isNotNull()).groupBy(group).agg(in_order("_c").alias("_cs")).select(group, fold(F.col("_cs"), kind).alias("_best"))
    best = best.filter(F.col("_best").isNotNull())
    check = clean.join(best, group)
    lost = F.count_if((F.col(item) != F.col("_best")[item]) & ~_beats(F.col("_best"), F.struct(*scores), scores, majority))
    won = check.groupBy(group, F.col("_best")[item].alias(item)).agg(lost.alias("_lost"))
    return won.filter(F.col("_lost") == 0).select(group, item)
