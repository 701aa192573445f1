"""Temporal splits and the history snapshot that is safe for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def within(t: Column, period: tuple[str, str] | None) -> Column:
    """The time, or NULL outside the period (from, before)."""
    if not period:
        return t
    low, high = (F.lit(x).cast("timestamp_ntz") for x in period)
    return F.when((t >= low) & (t < high), t)


def assign_splits(
    impressions: DataFrame, held_out: str, *, val: tuple[str, str] | None = None, val_days: int = 2,
    period: tuple[str, str] | None = None, check: bool = True,
) -> DataFrame:
    """Adds ``split`` by time alone; every row keeps its place in one split.

    Rows of source ``held_out`` are ``test``. Of the others those inside the inclusive
    day range ``val``, or in the last ``val_days`` calendar days, are ``val``; the rest,
    also rows without a time, are ``train``. With ``period`` (from, before) a time outside it counts as
    none, so a clock that is wrong by years moves no boundary. ValueError if the source is not there.
    """
    if not held_out:
        raise ValueError("a held-out source is needed")
    if check and not impressions.filter(F.col("source_split") == held_out).limit(1).count():
        raise ValueError(f"held-out source {held_out!r} is not in the data")
    other = ~F.col("source_split").eqNullSafe(F.lit(held_out))
    t = within(F.col("timestamp"), period)
    if val:
        late = (t >= F.lit(val[0]).cast("timestamp_ntz")) & (t < F.date_add(F.lit(val[1]).cast("date"), 1).cast("timestamp_ntz"))
        out = impressions
    else:
        newest = impressions.filter(other).agg(F.to_date(F.max(t)).alias("_day"))  # one row
        out = impressions.join(F.broadcast(newest))
        late = t >= F.date_sub(F.col("_day"), val_days - 1).cast("timestamp_ntz")
    label = F.when(~other, "test").when(F.coalesce(late, F.lit(False)), "val").otherwise("train")
    return out.withColumn("split", label).drop("_day")


def split_meta(impressions: DataFrame, period: tuple[str, str] | None = None) -> DataFrame:
    """One row per split: rows, users, clicks, first and last time (of those in ``period``), sources."""
    t = within(F.col("timestamp"), period)
    return impressions.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_impressions"), F.count_distinct("user_id").alias("n_users"),
        F.sum(F.size("clicked_ids")).alias("n_clicks"), F.min(t).alias("t_min"), F.max(t).alias("t_max"),
        F.array_join(F.sort_array(F.collect_set("source_split")), ",").alias("sources"),
    )


def snapshot_ends(history: DataFrame) -> DataFrame:
    """``(snapshot, end_ts)``: the latest click in each snapshot; NULL where clicks have no time."""
    return history.filter(F.col("snapshot").isNotNull()).groupBy("snapshot").agg(F.max("timestamp").alias("end_ts"))


def choose_snapshots(ends: DataFrame, meta: DataFrame, strict: bool = True) -> DataFrame:
    """``(split, snapshot)``: per split the newest snapshot that ends by the split's start.

    An as-of join on a handful of rows. A single snapshot without times serves every
    split. ``strict`` raises ValueError for a split without an eligible snapshot, or
    where several snapshots have no times; otherwise such splits are left out.
    """
    timed = ends.filter(F.col("end_ts").isNotNull())
    pairs = meta.select("split", "t_min").join(F.broadcast(timed), F.col("end_ts") <= F.col("t_min"))
    chosen = pairs.groupBy("split").agg(F.max(F.struct("end_ts", "snapshot")).alias("x")).select("split", F.col("x.snapshot").alias("snapshot"))
    if not strict:
        return chosen
    rows = ends.collect()  # one row per snapshot
    if rows and all(r["end_ts"] is None for r in rows):
        if len(rows) != 1:
            raise ValueError(f"{len(rows)} snapshots without times; cannot choose")
        return meta.select("split", F.lit(rows[0]["snapshot"]).alias("snapshot"))
    lacking = [r["split"] for r in meta.join(chosen, "split", "left_anti").collect()]
    if lacking:
        raise ValueError(f"no history snapshot ends before the start of {sorted(lacking)}")
    return chosen


def split_order(meta: DataFrame) -> DataFrame:
    """Each split after the first with whether it begins after its predecessor ends."""
    number = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    w = Window.orderBy("_no")  # three rows
    out = meta.withColumn("_no", number).withColumn("prev_end", F.lag("t_max").over(w)).withColumn("prev_split", F.lag("split").over(w))
    return out.filter(F.col("prev_split").isNotNull()).select("split", "prev_split", (F.col("prev_end") < F.col("t_min")).alias("is_disjoint"))


def assert_disjoint(meta: DataFrame) -> None:
    """AssertionError if split windows overlap or are out of order."""
    bad = [(r["prev_split"], r["split"]) for r in split_order(meta).filter(~F.col("is_disjoint")).collect()]
    if bad:
        raise AssertionError(f"split windows overlap: {bad}")


def explode_candidates(impressions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Long view, one row per shown article, with label 1 where it was clicked."""
    base = ["impression_id", "user_id", "timestamp", *extra]
    long = impressions.select(*base, "clicked_ids", F.posexplode("inview_ids").alias("pos", "article_id"))
    label = F.coalesce(F.array_contains("clicked_ids", F.col("article_id")), F.lit(False)).cast("int")
    return long.select(*base, "pos", "article_id", label.alias("label"))


def reference_report(impressions: DataFrame, history: DataFrame, articles: DataFrame) -> DataFrame:
    """Per list the percentage of its distinct ids that the catalogue knows; 100 for none."""
    ids = [
        (name, source.select(column.alias("article_id")).filter(F.col("article_id").isNotNull()).distinct())
        for name, source, column in (
            ("inview", impressions, F.explode("inview_ids")), ("clicked", impressions, F.explode("clicked_ids")), ("history", history, F.col("article_id")))
    ]
    known = articles.select("article_id").distinct().withColumn("_hit", F.lit(1))
    rows = []
    for name, df in ids:
        share = F.coalesce(100.0 * F.count("_hit") / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))), F.lit(100.0))
        rows.append(df.join(known, "article_id", "left").agg(F.count(F.lit(1)).alias("n_ids"), share.alias("pct_known")).select(F.lit(name).alias("source"), "n_ids", "pct_known"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def sample_key(*cols: Column | str, seed: int = 13) -> Column:
    from quillrank.functions.ids import md5_uniform

    return md5_uniform(*cols, seed=seed)


def sample_n(df: DataFrame, n: int, key: str = "impression_id", seed: int = 13) -> DataFrame:
    """A reproducible sample of ``n`` rows (0: all): the lowest by a hash of ``key``.

    The same rows in every engine and under every partitioning.
    """
    return df.orderBy(sample_key(key, seed=seed), key).limit(n) if n else df
