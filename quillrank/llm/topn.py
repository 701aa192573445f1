"""Top N items within every group by descending score bands (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.cut import cut

#: Up to this many filled groups (and 32 bytes a group) are broadcast.
MAX_FILLED = 1_000_000

# working columns, named so that no input column is taken for one
_SCORE, _BAND, _GROUP, _FILLED = "__top_n_score", "__top_n_band", "__top_n_group", "__top_n_filled"


def band_edges(scored: DataFrame, score: str, n: int, mean_size: float, bands: int) -> list[float]:
    """Lower edges of the upper bands, falling.

    The first band is sized to hold about ``2 n`` rows of an average group, each
    further one twice as many; the last band (no edge) takes the rest.
    """
    shares, share = [], 2.0 * n / max(mean_size, 1.0)
    while share < 1.0 and len(shares) < bands - 1:
        shares.append(1.0 - share)
        share *= 2.0
    if not shares:
        return []
    edges = scored.agg(F.percentile_approx(score, [float(x) for x in shares], F.lit(1000))).first()[0] or []
    return sorted({float(e) for e in edges}, reverse=True)


def top_n_by_bands(
    rows: DataFrame, group: str, score: str, ties: list[Column], n: int, *, bands: int = 8, missing: float | None = 0.0, rank: str = "rank"
) -> DataFrame:
    """The ``n`` rows of every group with the highest scores, numbered from 1.

    ``missing`` stands in for NULL and NaN scores (``None``: such rows rank below
    all numbers). Equal scores are ordered by ``ties``, which must tell any two rows
    of a group apart for a repeatable result. A NULL group is a group; fewer than
    ``n`` rows give as many as there are; all columns are kept, one named like
    ``rank`` is replaced.

    1. Global score quantiles cut the rows into a few descending bands.
    2. One map-side combined count per group and band tells, from the top band
       down, in which band each group gets its ``n``-th row.
    3. Bands are taken from the top. Rows of the first go on as they are; a row of a
       lower band only while its group was not already filled by higher bands
       (an anti-join with the filled groups, which are broadcast where
       they are few, so that rows that cannot count are left out where they are read).
    4. The survivors - all rows of the boundary band and above - are ranked
       exactly. The ranking limit is applied inside each map task before the
       shuffle, so even millions of rows tied in one boundary band arrive as at
       most ``n`` rows per task.

    No group is gathered, and no rows are dropped but those proven to be outside.
    """
    low = F.lit(float("-inf")) if missing is None else F.lit(float(missing))
    value = F.col(score).cast("double")
    rows = cut(rows.withColumn(_SCORE, F.when(value.isNull() | F.isnan(value), low).otherwise(value)))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(group).alias("g")).first()
    edges = band_edges(rows, _SCORE, n, size["n"] / max(size["g"], 1), bands)
    survivors = rows
    if edges:
        band = reduce(lambda rest, e: F.when(F.col(_SCORE) >= e[1], e[0]).otherwise(rest), reversed(list(enumerate(edges))), F.lit(len(edges)))
        banded = rows.withColumn(_BAND, band)
        reached = [F.count_if(F.col(_BAND) <= i).alias(f"c{i}") for i in range(len(edges))]
        counts = banded.groupBy(F.col(group).alias(_GROUP)).agg(*reached)
        filled_in = F.coalesce(*[F.when(F.col(f"c{i}") >= n, i) for i in range(len(edges))])
        filled = cut(counts.select(_GROUP, filled_in.alias(_FILLED)).filter(F.col(_FILLED).isNotNull()))
        few = filled.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.col(_GROUP).cast("string")), F.lit(0)))).first()
        if few[0] <= MAX_FILLED and (few[1] or 0) <= 32 * MAX_FILLED:
            filled = F.broadcast(filled)
        # a group filled by the top band alone has no use for rows below; rows of the top band are never in question
        lower = banded.filter(F.col(_BAND) > 0).join(filled, F.col(group).eqNullSafe(F.col(_GROUP)) & (F.col(_BAND) > F.col(_FILLED)), "left_anti")
        survivors = banded.filter(F.col(_BAND) == 0).unionByName(lower)
    w = Window.partitionBy(group).orderBy(F.col(_SCORE).desc(), *ties)
    ranked = survivors.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return ranked.drop(_SCORE, _BAND)
