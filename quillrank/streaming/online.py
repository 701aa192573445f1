"""Scoring a stream of impressions against static features.

A candidate list arrives in one row, so ranking a list needs no state: pairs of the
row's own array are scored with stream-static joins inside each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.submission import ranks
from quillrank.schema import schema_of


def read_impressions(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Impressions as a stream of Parquet files."""
    return spark.readStream.schema(schema_of("impressions")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_ranking(impressions: DataFrame, score, out: str, checkpoint: str, available_now: bool = True):
    """Write ``(impression_id, ranks)`` for every arriving list.

    ``score`` turns a batch's long candidates (``impression_id, pos, user_id,
    article_id``) into the same rows with ``score``. A replayed batch overwrites its
    own folder, so every list is written once.
    """
    def rank_batch(batch: DataFrame, batch_id: int) -> None:
        long = batch.select("impression_id", "user_id", F.posexplode("inview_ids").alias("pos", "article_id"))
        ranks(score(long)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = impressions.writeStream.foreachBatch(rank_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def click_counts(impressions: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Clicks per article and time window of a stream; rows later than ``lateness`` are dropped."""
    timed = impressions.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    clicks = timed.select("event_time", F.explode("clicked_ids").alias("article_id"))
    return clicks.groupBy(F.window("event_time", window), "article_id").agg(F.count(F.lit(1)).alias("clicks")).select(
        F.col("window.start").alias("window_start"), "article_id", "clicks")
