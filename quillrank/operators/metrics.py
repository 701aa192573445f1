"""Ranking and beyond-accuracy metrics per list and scorer.

Input is long: ``impression_id, pos, article_id, label, scorer, score``. All rank
windows share one partitioning by list and scorer, so they cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import dot, sum_vectors

KEY = ("scorer", "impression_id")
TOP = 10


def ranked(scores: DataFrame) -> DataFrame:
    """Adds ``rank`` (falling score, first place wins ties) and ``up_rank`` (rising, ties averaged)."""
    by_list = Window.partitionBy(*KEY)
    ties = Window.partitionBy(*KEY, "score")
    first = scores.withColumn("rank", F.row_number().over(by_list.orderBy(F.desc("score"), "pos")))
    return first.withColumn("up_rank", F.rank().over(by_list.orderBy("score")) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def _ndcg(k: int):
    gain = F.sum(F.when(F.col("rank") <= k, F.col("label") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    best = F.least(F.sum("label"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return F.when(best > 0, gain / ideal).otherwise(0.0)


def accuracy(ranked_scores: DataFrame) -> DataFrame:
    """``auc`` (NULL for lists of one class), ``mrr`` over all clicks, ``ndcg_5``, ``ndcg_10``."""
    pos = F.sum("label").cast("double")
    neg = F.sum(1 - F.col("label")).cast("double")
    up = F.sum(F.when(F.col("label") == 1, F.col("up_rank")).otherwise(0.0))
    area = (up - pos * (pos + 1) / 2) / (pos * neg)
    mrr = F.sum(F.col("label") / F.col("rank")) / pos
    return ranked_scores.groupBy(*KEY).agg(
        F.when((pos > 0) & (neg > 0), area).alias("auc"), F.when(pos > 0, mrr).otherwise(0.0).alias("mrr"),
        _ndcg(5).alias("ndcg_5"), _ndcg(10).alias("ndcg_10"))


def top_lists(ranked_scores: DataFrame, k: int = TOP) -> DataFrame:
    return ranked_scores.filter(F.col("rank") <= k)


def top_k(scores: DataFrame, k: int = TOP) -> DataFrame:
    """Only the first ``k`` of every list; the limit is applied before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("score"), "pos")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def diversity(top: DataFrame, units: DataFrame, dim: int) -> DataFrame:
    """One minus the mean cosine of two different recommended articles; NULL below two.

    The sum of all cosines is the squared length of the summed unit vectors, so one
    vector sum per list replaces the pairs. Articles outside the catalogue are left
    out, zero vectors stay in.
    """
    joined = top.join(units.select("article_id", "unit"), "article_id").withColumn("_q", dot("unit", "unit"))
    sums = sum_vectors(joined, list(KEY), "unit", dim, extra=[F.sum("_q").alias("_q"), F.count(F.lit(1)).alias("_n")])
    n = F.col("_n")
    found = sums.select(*KEY, F.when(n >= 2, 1 - (dot("total", "total") - F.col("_q")) / (n * (n - 1))).alias("diversity"))
    return top.select(*KEY).distinct().join(found, list(KEY), "left")


def category_entropy(top: DataFrame, articles: DataFrame) -> DataFrame:
    """Entropy in bits of a list's categories; unknown articles count as category ``''``."""
    cats = articles.select("article_id", "category")
    named = top.join(cats, "article_id", "left").withColumn("_c", F.coalesce("category", F.lit("")))
    counts = named.groupBy(*KEY, "_c").agg(F.count(F.lit(1)).alias("_n"))
    # -sum(p log p) = log n - sum(c log c) / n, in one aggregation
    n = F.sum("_n")
    return counts.groupBy(*KEY).agg((F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("cat_entropy"))


def novelty(top: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean surprise in bits of a list's articles by train clicks; 0 without any clicks."""
    total = popularity.agg(F.coalesce(F.sum("train_clicks"), F.lit(0)).alias("_total"))
    joined = top.join(popularity.select("article_id", "train_clicks"), "article_id", "left").join(F.broadcast(total))
    bits = -F.log2((F.coalesce("train_clicks", F.lit(0)) + 1) / (F.col("_total") + 1))
    return joined.groupBy(*KEY).agg(F.avg(F.when(F.col("_total") > 0, bits).otherwise(0.0)).alias("novelty"))


def coverage(top: DataFrame, articles: DataFrame) -> DataFrame:
    """Per scorer the distinct recommended articles, and their number over the catalogue's."""
    size = articles.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("_size"))
    shown = top.groupBy("scorer").agg(F.count_distinct("article_id").alias("n_recommended"))
    return shown.join(F.broadcast(size)).select("scorer", "n_recommended", (F.col("n_recommended") / F.col("_size")).alias("coverage"))


def list_metrics(scores: DataFrame, articles: DataFrame, popularity: DataFrame, units: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """All metrics of every list and scorer, one row each."""
    r = ranked(scores)
    top = top_lists(r)
    out = accuracy(r)
    pieces = ([diversity(top, units, dim)] if units is not None else []) + [category_entropy(top, articles), novelty(top, popularity)]
    for piece in pieces:
        out = out.join(piece, list(KEY), "left")
    return out
