"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
#: Up to this dimension a vector sum is one aggregate per component; beyond, cells are exploded.
WIDE = 512


def dot(a: Column | str, b: Column | str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def divide(v: Column | str, by: Column) -> Column:
    """Every component over ``by``.

    The divisor goes in as an argument, which is computed once per row; inside the
    lambda it would be computed again for every component.
    """
    v = F.col(v) if isinstance(v, str) else v
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, n: x.cast("double") / n)


def l2_normalize(v: Column | str) -> Column:
    """The vector at length 1; the zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    return divide(v, F.greatest(norm(v), F.lit(EPS)))


def sum_vectors(df: DataFrame, keys: list[str], vector: str, dim: int, weight: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    """``keys``, ``total`` (weighted vector sum, of length ``dim``) and the ``extra`` aggregates.

    One aggregate per component keeps a row a row: partial sums of whole vectors are
    combined on the map side and nothing is exploded.
    """
    extra = extra or []
    scale = (lambda x: x) if weight is None else (lambda x: weight * x)
    if dim <= WIDE:
        sums = [F.sum(scale(F.get(F.col(vector), F.lit(i)).cast("double"))).alias(f"_s{i}") for i in range(dim)]
        out = df.groupBy(*keys).agg(*sums, *extra)
        rest = [c for c in out.columns if not c.startswith("_s")]
        return out.select(*rest, F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias("total"))
    cells = df.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = cells.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_m"))
    total = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(*keys, F.col("_v._m").alias("total"))
    return df.groupBy(*keys).agg(*extra).join(total, keys) if extra else total
