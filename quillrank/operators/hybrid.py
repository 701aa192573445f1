"""Per-list scaling and the learned combination of two scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def minmax(scored: DataFrame, score: str, out: str, group: str = "impression_id") -> DataFrame:
    """Scores of a list moved to [0, 1]; a list without range gives zeros."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn(out, F.when(high - low < EPS, F.lit(0.0)).otherwise((F.col(score) - low) / (high - low)))


def fit_hybrid(scored: DataFrame, features: tuple[str, str] = ("bm25", "semantic"), label: str = "label") -> dict[str, float]:
    """Balanced, L2-regularised logistic regression on the scaled scores of candidates.

    The objective is ``|w|^2 / 2 + sum(weight * log loss)`` with class weights
    ``n / (2 n_class)``; returns coefficients and intercept.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaled = minmax(minmax(scored, features[0], "_x0"), features[1], "_x1").select("_x0", "_x1", F.col(label).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in scaled.groupBy("label").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("fitting needs clicked and not clicked candidates")
    weight = F.lit(0.0)
    for value, c in counts.items():
        weight = F.when(F.col("label") == value, n / (2.0 * c)).otherwise(weight)
    data = VectorAssembler(inputCols=["_x0", "_x1"], outputCol="features").transform(scaled.withColumn("_w", weight))
    model = LogisticRegression(weightCol="_w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10).fit(data)
    return {features[0]: float(model.coefficients[0]), features[1]: float(model.coefficients[1]), "intercept": float(model.intercept)}


def hybrid_probability(a: Column | str, b: Column | str, coefficients: dict[str, float], features: tuple[str, str] = ("bm25", "semantic")) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    z = F.lit(coefficients[features[0]]) * a + F.lit(coefficients[features[1]]) * b + F.lit(coefficients["intercept"])
    return 1 / (1 + F.exp(-z))


def apply_hybrid(scored: DataFrame, coefficients: dict[str, float], features: tuple[str, str] = ("bm25", "semantic"), out: str = "hybrid") -> DataFrame:
    """Adds the combined probability, computed from the scores scaled within each list."""
    scaled = minmax(minmax(scored, features[0], "_x0"), features[1], "_x1")
    return scaled.withColumn(out, hybrid_probability("_x0", "_x1", coefficients, features)).drop("_x0", "_x1")
