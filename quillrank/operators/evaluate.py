"""Slices, summaries, bootstrap intervals and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("auc", "mrr", "ndcg_5", "ndcg_10", "diversity", "cat_entropy", "novelty")
SLICES = ("all", "cold_users", "warm_users", "head_clicks", "tail_clicks")


def slice_flags(impressions: DataFrame, profiles: DataFrame, features: DataFrame) -> DataFrame:
    """``(impression_id, slice)``, one row for each overlapping slice an impression is in.

    Cold users have a low-history profile in the impression's split; all others,
    also users without profile, are warm. Head: any clicked article is a head one.
    """
    low = profiles.filter("is_low_history").select("user_id", "split").distinct().withColumn("_cold", F.lit(True))
    clicked = impressions.select("impression_id", F.explode("clicked_ids").alias("article_id"))
    head = clicked.join(features.filter("is_head").select("article_id"), "article_id", "left_semi").select("impression_id").distinct().withColumn("_head", F.lit(True))
    flags = impressions.select("impression_id", "user_id", "split").join(low, ["user_id", "split"], "left").join(head, "impression_id", "left")
    cold, is_head = F.coalesce("_cold", F.lit(False)), F.coalesce("_head", F.lit(False))
    names = F.array(F.lit("all"), F.when(cold, "cold_users").otherwise("warm_users"), F.when(is_head, "head_clicks").otherwise("tail_clicks"))
    return flags.select("impression_id", F.explode(names).alias("slice"))


def long_metrics(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """``(scorer, impression_id, metric, value)``."""
    have = [n for n in names if n in metrics.columns]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in have]))
    return metrics.select("scorer", "impression_id", each.alias("x")).select("scorer", "impression_id", "x.metric", "x.value")


def summaries(metrics: DataFrame, slices: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean, defined and undefined lists per scorer, slice and metric."""
    joined = long_metrics(metrics, names).join(slices, "impression_id")
    return joined.groupBy("scorer", "slice", "metric").agg(
        F.avg("value").alias("value"), F.count("value").alias("n"), (F.count(F.lit(1)) - F.count("value")).alias("n_undefined"))


#: Numbers drawn at once while means are resampled (8 bytes each).
DRAWN = 8_000_000


def resampled_means(values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Means of ``draws`` samples with replacement, drawn row after row in pieces of bounded memory."""
    rng, n = np.random.default_rng(seed), len(values)
    rows = [min(draws - done, max(1, DRAWN // n)) for done in range(0, draws, max(1, DRAWN // n))]
    return np.concatenate([values[rng.integers(n, size=(r, n))].mean(axis=1) for r in rows])


def mean_interval(values: np.ndarray, *, level: float = 0.95, draws: int = 1000, seed: int = 13) -> tuple[float, float, float]:
    """``(mean, low, high)`` of the values that are numbers, by the bootstrap.

    Below two values there is nothing to resample: all three are the value, or NaN.
    """
    known = np.asarray(values, np.float64)
    known = known[known == known]
    centre = float(known.mean()) if known.size else float("nan")
    if known.size < 2:
        return centre, centre, centre
    outside = (1.0 - level) / 2
    low, high = np.quantile(resampled_means(known, draws, seed), (outside, 1.0 - outside)).tolist()
    return centre, low, high


def intervals(metrics: DataFrame, slices: DataFrame, names: tuple[str, ...] = METRICS, n_boot: int = 1000, seed: int = 13) -> DataFrame:
    """Bootstrap intervals per scorer, slice and metric over lists in id order.

    Meant for evaluation samples: a group holds one number per sampled list.
    """
    joined = long_metrics(metrics, names).join(slices, "impression_id")

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("impression_id")["value"].to_numpy()
        mean, low, high = mean_interval(ordered, draws=n_boot, seed=seed)
        return pd.DataFrame([(*key, mean, low, high, int((~np.isnan(ordered)).sum()))], columns=["scorer", "slice", "metric", "value", "ci_low", "ci_high", "n"])

    return joined.groupBy("scorer", "slice", "metric").applyInPandas(
        resample, "scorer string, slice string, metric string, value double, ci_low double, ci_high double, n bigint")


def poisson_intervals(metrics: DataFrame, slices: DataFrame, names: tuple[str, ...] = METRICS, n_boot: int = 200) -> DataFrame:
    """Bootstrap intervals without gathering lists: Poisson(1) weights from hashes.

    For samples too large for :func:`intervals`: every list gets ``n_boot`` weights
    that depend on its id only, and the resampled means are ordinary aggregates.
    """
    joined = long_metrics(metrics, names).filter(F.col("value").isNotNull()).join(slices, "impression_id")
    draws = joined.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = (F.pmod(F.xxhash64("impression_id", "_b"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # inverse distribution of Poisson(1)
    cdf, term, weight = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(12):
        cdf += term
        weight = weight + F.when(u > cdf, 1).otherwise(0)
        term /= k + 1
    total = F.sum("_w")  # in a small group all weights of a draw can be 0
    means = draws.withColumn("_w", weight).groupBy("scorer", "slice", "metric", "_b").agg((F.sum(F.col("_w") * F.col("value")) / F.when(total > 0, total)).alias("_m"))
    return means.groupBy("scorer", "slice", "metric").agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"))


def report(summary: DataFrame, cover: DataFrame, params: dict) -> dict:
    """Nested report from the few summary rows; slices without lists are marked unavailable."""
    out: dict = {"params": params, "scorers": {}}
    for r in cover.collect():
        out["scorers"][r["scorer"]] = {"coverage": r["coverage"], "n_distinct_recommended": r["n_recommended"], "slices": {s: {"available": False} for s in SLICES}}
    for r in summary.collect():
        part = out["scorers"].setdefault(r["scorer"], {"slices": {}})["slices"]
        entry = part.get(r["slice"], {})
        entry.pop("available", None)
        entry[r["metric"]] = {k: r[k] for k in r.asDict() if k not in ("scorer", "slice", "metric")}
        part[r["slice"]] = entry
    return out
