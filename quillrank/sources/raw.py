"""Scans of raw news logs: headerless TSV, Parquet, vectors, and their cell formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the files, in order, and the format of their times.
NEWS_COLUMNS = ("article_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIOR_COLUMNS = ("impression_id", "user_id", "time", "history", "impressions")
BEHAVIOR_TIME = "M/d/yyyy h:mm:ss a"


def row_place() -> Column:
    """A row's place in a scan of files: path, start of the split and order in it. Comparable, whatever order splits are read in."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def scan_tsv(spark: SparkSession, paths: str | list[str], columns: tuple[str, ...]) -> DataFrame:
    """Text columns of headerless, tab-separated files; quotes are text, empty stays empty.

    ``file_no`` (place in ``paths``) and ``row_no`` (order within the file, or the
    folder's files by name) keep the provenance of every row.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = ", ".join(f"`{c}` string" for c in columns)
    frames = []
    for no, path in enumerate(paths):
        df = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", False).csv(path)
        frames.append(df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], F.lit(no).alias("file_no"), row_place().alias("row_no")))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def vector_scan(df: DataFrame) -> DataFrame:
    """``(article_id, vec)`` from the first and second column, whatever their names."""
    first, second = df.columns[:2]
    return df.select(F.col(first).cast("string").alias("article_id"), F.col(second).cast("array<float>").alias("vec"))


def parse_candidates(packed: Column | str) -> tuple[Column, Column]:
    """Shown and clicked ids of a packed list such as ``N1-1 N2-0 N3``.

    The label follows the last dash; a token without one, or with nothing before
    it, is an unlabelled candidate. Label ``1`` is a click.
    """
    packed = F.col(packed) if isinstance(packed, str) else packed
    tokens = F.filter(F.split(F.trim(packed), r"\s+"), lambda t: t != "")
    labelled = r"^(.+)-([^-]*)$"
    name = lambda t: F.when(t.rlike(labelled), F.regexp_extract(t, labelled, 1)).otherwise(t)
    clicked = F.filter(tokens, lambda t: t.rlike(labelled) & (F.regexp_extract(t, labelled, 2) == "1"))
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(tokens, name), none), F.coalesce(F.transform(clicked, name), none)


def entity_labels(*blobs: Column | str) -> Column:
    """Distinct non-empty ``Label`` values of JSON arrays of objects, in first-seen order.

    Elements that are no objects are skipped; empty, ``null`` or broken text gives none.
    """
    none = F.array().cast("array<string>")

    def labels(blob: Column | str) -> Column:
        blob = F.col(blob) if isinstance(blob, str) else blob
        found = F.transform(F.from_json(blob, "array<string>"), lambda e: F.get_json_object(e, "$.Label"))
        return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), none)

    return F.array_distinct(F.concat(*[labels(b) for b in blobs]))


def parse_time(text: Column | str, fmt: str = BEHAVIOR_TIME, strict: bool = True) -> Column:
    """A time without zone; malformed text fails, or is NULL if not ``strict``."""
    text = F.col(text) if isinstance(text, str) else text
    if strict:
        return F.to_timestamp_ntz(text, F.lit(fmt))
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def surrogate_ids(df: DataFrame, order: list[str], name: str = "impression_id") -> DataFrame:
    """Dense ids from 0 in the given order, without gathering the rows in one task.

    Rows are range-partitioned by ``order`` and sorted; every partition's count gives
    the next one's offset.
    """
    from quillrank.operators.cut import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets.select("_part", "_off")), "_part")
    return joined.withColumn(name, F.col("_off") + inside).drop("_at", "_part", "_off")


def history_rows(df: DataFrame, user: str, ids: str, times: str | None, snapshot: Column) -> DataFrame:
    """One history row per list element; position from 0.

    Parallel lists of different lengths fail the query; NULL and empty lists give no rows.
    """
    if times is None:
        long = df.select(F.col(user).alias("user_id"), F.posexplode(ids).alias("position", "article_id"), snapshot.alias("snapshot"))
        long = long.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    else:
        same = F.coalesce(F.size(F.col(ids)) == F.size(F.col(times)), F.lit(True))
        checked = df.filter(F.when(same, True).otherwise(F.raise_error(F.lit("history lists differ in length")).cast("boolean")))
        zipped = F.arrays_zip(F.col(ids).alias("a"), F.col(times).alias("t"))
        long = checked.select(F.col(user).alias("user_id"), F.posexplode(zipped).alias("position", "x"), snapshot.alias("snapshot"))
        long = long.select("user_id", F.col("x.a").alias("article_id"), F.col("x.t").cast("timestamp_ntz").alias("timestamp"), "position", "snapshot")
    return long.select(F.col("user_id").cast("string"), F.col("article_id").cast("string"), "timestamp", F.col("position").cast("int"), "snapshot")
