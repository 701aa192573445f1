"""Scoring the candidates of a split with every scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.ids import md5_uniform
from quillrank.operators.lexical import score_pairs
from quillrank.operators.semantic import mean_pair_scores, topk_pair_scores, user_vectors

SCORERS = ("random", "popularity", "bm25", "semantic", "hybrid")


def score_random(candidates: DataFrame, seed: int = 13, name: str = "random") -> DataFrame:
    return candidates.withColumn(name, md5_uniform("impression_id", "pos", seed=seed))


def score_popularity(candidates: DataFrame, popularity: DataFrame, name: str = "popularity") -> DataFrame:
    known = popularity.select("article_id", F.col("train_clicks").cast("double").alias(name))
    return candidates.join(known, "article_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def popularity_topk(popularity: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    known = popularity if allowed is None else popularity.join(allowed.select("article_id"), "article_id", "left_semi")
    return known.orderBy(F.desc("train_clicks"), "article_id").limit(k).select("article_id", "train_clicks")


def score_leaky(candidates: DataFrame, counts: DataFrame | None, value: str, declared: bool, name: str = "popularity_leaky") -> DataFrame | None:
    """Popularity that is not known when serving, for an ablation only; None unless declared."""
    if not declared or counts is None:
        return None
    known = counts.groupBy("article_id").agg(F.max(F.col(value).cast("double")).alias(name))
    return candidates.join(known, "article_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def score_candidates(
    candidates: DataFrame, *, popularity: DataFrame, clicks: DataFrame, queries: DataFrame, index: DataFrame, units: DataFrame,
    dim: int, pooling: str = "mean", topk: int = 5, seed: int = 13,
) -> DataFrame:
    """Candidates (``impression_id, pos, user_id, split, article_id, label``) with a column per scorer.

    Pair scores depend on user and article only, so each distinct pair is scored once.
    """
    pairs = candidates.select("user_id", "split", "article_id").filter(F.col("user_id").isNotNull()).distinct()
    scored = score_pairs(pairs, queries, index)
    if pooling == "mean":
        scored = mean_pair_scores(scored, user_vectors(clicks, units, dim), units)
    elif pooling == "topk":
        scored = topk_pair_scores(scored, clicks, units, topk)
    else:
        raise ValueError(f"unknown pooling {pooling!r}")
    out = score_popularity(score_random(candidates, seed), popularity)
    out = out.join(scored, ["user_id", "split", "article_id"], "left")
    return out.withColumn("bm25", F.coalesce("bm25", F.lit(0.0))).withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def long_scores(wide: DataFrame, scorers: tuple[str, ...], keep: tuple[str, ...] = ("impression_id", "pos", "article_id", "label")) -> DataFrame:
    """One row per candidate and scorer, in one pass over the candidates.

    Candidates are shuffled by list before they are multiplied by the scorers; every
    window and aggregate by list and scorer then finds its rows in place.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("score")) for s in scorers]))
    return wide.select(*keep, *scorers).repartition("impression_id").select(*keep, each.alias("x")).select(*keep, "x.scorer", "x.score")


METHODS = ("semantic", "bm25", "popularity", "hybrid")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    return method
