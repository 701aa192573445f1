"""Cutting lineage through a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillrank-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike ``checkpoint()`` the input is computed once, columns stay prunable and
    a lost executor costs nothing, as the files outlive it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillrank-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stream(files: list[str], columns: list[str] | None, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows of a table that ``cut`` has written (its ``inputFiles()``).

    For tasks that meet the whole table: each reads the one copy in the shared folder
    piece by piece, and no copy for each of them goes through a shuffle.
    """
    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from (b for b in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns, use_threads=False) if len(b))


@atexit.register
def release() -> None:
    """Delete the tables written so far; results that still read them must be done."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may already be gone
            pass
