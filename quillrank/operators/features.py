"""Feature store: tokens, train-only popularity, bands and user profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import index_text, tokenize

HEAD_SHARE = 0.20
COLD_CLICKS = 5
LOW_HISTORY = 0.25


def train_popularity(articles: DataFrame, train: DataFrame) -> DataFrame:
    """``(article_id, train_clicks)`` of all catalogue articles; repeated clicks count."""
    clicks = train.select(F.explode("clicked_ids").alias("article_id")).groupBy("article_id").agg(F.count(F.lit(1)).alias("train_clicks"))
    return articles.select("article_id").join(clicks, "article_id", "left").select("article_id", F.coalesce("train_clicks", F.lit(0)).cast("bigint").alias("train_clicks"))


def popularity_rank(popularity: DataFrame) -> DataFrame:
    """Adds ``popularity_rank`` from 0: falling clicks, then id.

    Ranks come from a range-partitioned sort and partition offsets, so no task holds
    the catalogue.
    """
    from quillrank.sources.raw import surrogate_ids

    keyed = popularity.withColumn("_neg", -F.col("train_clicks"))
    return surrogate_ids(keyed, ["_neg", "article_id"], "popularity_rank").drop("_neg")


def head_band(ranked: DataFrame, share: float = HEAD_SHARE) -> DataFrame:
    """Adds ``is_head``: among the first ``share`` of the clicked articles by rank."""
    clicked = ranked.agg(F.count_if(F.col("train_clicks") > 0).alias("_clicked"))  # one row
    head = (F.col("popularity_rank") < F.floor(F.col("_clicked") * share)) & (F.col("train_clicks") > 0)
    return ranked.join(F.broadcast(clicked)).withColumn("is_head", head).drop("_clicked")


def article_features(articles: DataFrame, train: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), language: str = "en") -> DataFrame:
    ranked = head_band(popularity_rank(train_popularity(articles, train)))
    tokens = articles.withColumn("tokens", tokenize(index_text(*fields), language))
    kept = [c for c in ("article_id", "title", "abstract", "category", "published_time") if c in articles.columns]
    return tokens.select(*kept, "tokens", F.size("tokens").alias("n_tokens")).join(ranked, "article_id")


def top_share(ranked: DataFrame, percent: int = 1) -> DataFrame:
    """Share of all train clicks that falls on the first ``percent`` % of the catalogue."""
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    top = F.col("popularity_rank") < F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))
    return ranked.join(F.broadcast(n)).agg((F.sum(F.when(top, F.col("train_clicks")).otherwise(0)) / F.greatest(F.lit(1), F.sum("train_clicks"))).alias("top_share"))


def split_history(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """History rows of each split's safe snapshot, with ``split``."""
    return history.join(F.broadcast(chosen), "snapshot")  # one row per split


def user_profiles(history: DataFrame, chosen: DataFrame, cold: int = COLD_CLICKS, low: float = LOW_HISTORY) -> DataFrame:
    """Per user and split the clicks of the safe snapshot, oldest first, with flags.

    ``is_low_history``: at most the exact ``low`` quantile of clicks per profile in
    the split. Use :func:`recent_clicks` where only the last clicks matter.
    """
    rows = split_history(history, chosen)
    lists = rows.groupBy("user_id", "split").agg(
        F.array_sort(F.collect_list(F.struct("position", "article_id"))).alias("x"), F.max("timestamp").alias("last_click_time"))
    lists = lists.select("user_id", "split", F.col("x.article_id").alias("clicked_ids"), F.size("x").alias("n_clicks"), "last_click_time")
    return history_flags(lists, cold, low)


def history_flags(profiles: DataFrame, cold: int = COLD_CLICKS, low: float = LOW_HISTORY) -> DataFrame:
    limits = profiles.groupBy("split").agg(F.percentile("n_clicks", F.lit(low)).alias("_limit"))
    out = profiles.withColumn("is_cold", F.col("n_clicks") < cold).join(F.broadcast(limits), "split")
    return out.withColumn("is_low_history", F.col("n_clicks") <= F.col("_limit")).drop("_limit")


def click_counts(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(user_id, split, n_clicks)`` without building any list."""
    return split_history(history, chosen).groupBy("user_id", "split").agg(F.count(F.lit(1)).cast("int").alias("n_clicks"))


def recent_clicks(history: DataFrame, chosen: DataFrame, n: int = 20, users: DataFrame | None = None) -> DataFrame:
    """Long ``(user_id, split, article_id, age)``: the last ``n`` clicks, age 0 the newest.

    The limit is applied inside map tasks before the shuffle, so a user with very
    many clicks costs no more than ``n`` rows per task. ``users`` (``user_id``,
    ``split``) restricts by a semi-join.
    """
    rows = split_history(history, chosen)
    if users is not None:
        rows = rows.join(users.select("user_id", "split").distinct(), ["user_id", "split"], "left_semi")
    w = Window.partitionBy("user_id", "split").orderBy(F.desc("position"), F.desc("article_id"))
    return rows.withColumn("age", F.row_number().over(w) - 1).filter(F.col("age") < n).select("user_id", "split", "article_id", "age")


def feature_stats(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if(F.col("train_clicks") > 0).alias("n_clicked"),
        F.avg("n_tokens").alias("mean_tokens"), F.count_if(F.col("n_tokens") == 0).alias("n_empty"))


def profile_stats(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if("is_cold").alias("n_cold"), F.count_if("is_low_history").alias("n_low_history"),
        F.avg("n_clicks").alias("mean_clicks"))


def build_pool(articles: DataFrame, impressions: DataFrame, kind: str, can_fresh: bool = True) -> tuple[DataFrame | None, str]:
    """Candidate articles and a reason where there are none.

    ``all``: the catalogue; ``circulating``: what the given impressions show;
    ``fresh``: published by their latest time (unknown times are not).
    """
    ids = articles.select("article_id", "published_time")
    if kind == "all":
        return ids.select("article_id"), ""
    if kind == "circulating":
        shown = impressions.select(F.explode("inview_ids").alias("article_id")).distinct()
        return ids.select("article_id").join(shown, "article_id", "left_semi"), ""
    if kind == "fresh":
        if not can_fresh:
            return None, "the dataset has no publication times"
        newest = impressions.agg(F.max("timestamp").alias("_newest"))
        return ids.join(F.broadcast(newest), F.col("published_time") <= F.col("_newest")).select("article_id"), ""
    raise ValueError(f"unknown pool {kind!r}")
