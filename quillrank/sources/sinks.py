"""Writers for tables, reports and ranked-list files."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.cut import shared_dir
from quillrank.schema import schema_of, validate


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Write a unified table after validation."""
    writer = validate(df, name).write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_splits(impressions: DataFrame, path: str) -> None:
    """One folder per split, so that readers of a split prune the others."""
    impressions.write.mode("overwrite").partitionBy("split").parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a unified table and validate what the files hold."""
    return validate(spark.read.parquet(path), name).select(*[f.name for f in schema_of(name)])


def write_report(report: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(report, indent=2, default=str), encoding="utf-8")


def write_submission(lines: DataFrame, out: str | Path, name: str = "prediction.txt", work: str | None = None) -> Path:
    """Zip one text file of ``line`` values in the order of ``row_no``.

    The executors write the lines in sorted parts to ``work``, by default a folder in
    the one that all executors share; the driver appends the parts to the archive,
    one at a time, checks that every line has arrived, and deletes them.
    """
    out, spark = Path(out), lines.sparkSession
    parts = work or f"{shared_dir(spark)}/quillrank-{uuid.uuid4().hex}"
    written = Observation()
    ordered = lines.repartitionByRange("row_no").sortWithinPartitions("row_no").observe(written, F.count(F.lit(1)).alias("lines"))
    ordered.select("line").write.mode("overwrite").text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = 0
    try:
        names = sorted(f.getPath().getName() for f in files.listStatus(path(parts)) if f.getPath().getName().startswith("part-"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(name, "w", force_zip64=True) as target, tempfile.TemporaryDirectory() as here:
            for part in names:
                copy = Path(here) / "part"
                files.copyToLocalFile(False, path(f"{parts}/{part}"), path(f"file://{copy}"), True)
                with copy.open("rb") as source:
                    while block := source.read(1 << 20):
                        found += block.count(b"\n")
                        target.write(block)
    finally:
        files.delete(path(parts), True)
    if found != written.get["lines"]:
        out.unlink()
        raise OSError(f"{written.get['lines']} lines were written, {found} arrived")
    return out
