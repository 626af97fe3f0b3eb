"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode, as in tests;
    anywhere else that is an error, as executors would write to disks of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = held.get() if held.isDefined() else None
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(top)
    if ":" not in top.split("/")[0]:
        top = "file://" + top
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def kept(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe when an executor is lost.

    batch_rows: rows of an Arrow batch while df is written, for rows that hold long texts (by default the session's number).
    """
    spark, path, name = df.sparkSession, folder(df.sparkSession), "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    if batch_rows:
        spark.conf.set(name, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, usual)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tessera-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
