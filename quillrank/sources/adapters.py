"""Raw layouts into the unified tables; only this module knows a layout's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.config import Config
from quillrank.functions.text import string_list
from quillrank.schema import validate
from quillrank.sources.raw import (
    BEHAVIOR_COLUMNS, NEWS_COLUMNS, entity_labels, first_per_key, history_rows, parse_candidates, parse_time, row_place, scan_tsv, surrogate_ids,
)

Tables = tuple[DataFrame, DataFrame, DataFrame]


def tsv_log(spark: SparkSession, cfg: Config) -> Tables:
    """Headerless TSV files: two catalogues and two behaviour logs (train, dev)."""
    cfg.require("train_news", "train_behaviors", "dev_news", "dev_behaviors")
    news = scan_tsv(spark, [cfg.raw["train_news"], cfg.raw["dev_news"]], NEWS_COLUMNS)
    news = first_per_key(news, ["article_id"], [F.col("file_no"), F.col("row_no")])
    articles = news.select(
        "article_id", "title", "abstract", F.lit("").alias("body"), "category", "subcategory",
        entity_labels("title_entities", "abstract_entities").alias("entities"), F.lit(None).cast("timestamp_ntz").alias("published_time"))
    log = scan_tsv(spark, [cfg.raw["train_behaviors"], cfg.raw["dev_behaviors"]], BEHAVIOR_COLUMNS)
    shown, clicked = parse_candidates("impressions")
    numbered = surrogate_ids(log.withColumnRenamed("impression_id", "_source"), ["file_no", "row_no"])
    impressions = numbered.select(
        "impression_id", F.col("_source").cast("bigint").alias("source_impression_id"), "user_id", parse_time("time").alias("timestamp"),
        shown.alias("inview_ids"), clicked.alias("clicked_ids"), F.when(F.col("file_no") == 0, "train").otherwise("dev").alias("source_split"))
    one = first_per_key(log.select("user_id", "history", "file_no", "row_no"), ["user_id"], [F.col("file_no"), F.col("row_no")])
    ids = F.filter(F.split(F.trim("history"), r"\s+"), lambda x: x != "")
    history = history_rows(one.withColumn("ids", ids), "user_id", "ids", None, F.lit("all"))
    return articles, impressions, history


def adapt_articles(raw: DataFrame) -> DataFrame:
    """Articles of the nested Parquet layout: renamed, NULL text as empty, lists joined."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select(
        F.col("article_id").cast("string").alias("article_id"), text("title").alias("title"), text("subtitle").alias("abstract"), text("body").alias("body"),
        text("category_str").alias("category"), F.array_join(string_list("subcategory"), "|").alias("subcategory"),
        string_list("ner_clusters").alias("entities"), F.col("published_time").cast("timestamp_ntz").alias("published_time"))


def parquet_log(spark: SparkSession, cfg: Config) -> Tables:
    """Nested Parquet files: articles, and behaviours and history for train and val."""
    cfg.require("articles", "train_behaviors", "train_history", "val_behaviors", "val_history")
    articles = adapt_articles(spark.read.parquet(cfg.raw["articles"]))
    logs, histories = [], []
    for no, split in enumerate(("train", "val")):
        log = spark.read.parquet(cfg.raw[f"{split}_behaviors"])
        logs.append(log.select(
            F.col("impression_id").cast("bigint").alias("source_impression_id"), F.col("user_id").cast("string").alias("user_id"),
            F.col("impression_time").cast("timestamp_ntz").alias("timestamp"), string_list("article_ids_inview").alias("inview_ids"),
            string_list("article_ids_clicked").alias("clicked_ids"), F.lit(split).alias("source_split"), F.lit(no).alias("file_no"),
            row_place().alias("row_no")))
        past = spark.read.parquet(cfg.raw[f"{split}_history"])
        histories.append(history_rows(past, "user_id", "article_id_fixed", "impression_time_fixed", F.lit(split)))
    impressions = surrogate_ids(logs[0].unionByName(logs[1]), ["file_no", "row_no"])
    return articles, impressions.drop("file_no", "row_no"), histories[0].unionByName(histories[1])


ADAPTERS: dict[str, Callable[[SparkSession, Config], Tables]] = {"tsv": tsv_log, "parquet": parquet_log}


def load_unified(spark: SparkSession, cfg: Config, layout: str, limit: int | None = None) -> Tables:
    """The three unified tables, validated; ``limit`` keeps the first impressions by id."""
    if layout not in ADAPTERS:
        raise ValueError(f"unknown layout {layout!r}; known: {sorted(ADAPTERS)}")
    articles, impressions, history = ADAPTERS[layout](spark, cfg)
    if limit:
        impressions = impressions.orderBy("impression_id").limit(limit)
    return validate(articles, "articles"), validate(impressions, "impressions"), validate(history, "history")
