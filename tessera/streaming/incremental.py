"""Streams: models that learn batch by batch, and scoring of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.decomposition import IncrementalPCA
from ..sources.io import load_classical, save_classical


def fit_stream(stream: DataFrame, model: IncrementalPCA, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds each micro-batch to the model's partial_fit; its state merges, so batches may be cut anywhere. once: takes what is
    there and ends.

    The model is written beside the checkpoint under its last batch's number, in one step with it. A query that is started again
    takes the model up from there, and a batch that is replayed after a failure is recognised by its number.
    """
    spark, top = stream.sparkSession, f"{checkpoint.rstrip('/')}-model"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(top).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers() -> list[int]:
        held = [f.getPath().getName() for f in files.listStatus(path(top))] if files.exists(path(top)) else []
        return sorted(int(n) for n in held if n.isdigit())

    last = max(numbers(), default=-1)
    if last >= 0:
        model.__dict__.update(vars(load_classical(spark, f"{top}/{last}")))

    def step(batch: DataFrame, number: int) -> None:
        if number <= max(numbers(), default=-1):
            return
        model.partial_fit(batch)
        save_classical(spark, model, f"{top}/part-{number}")
        files.rename(path(f"{top}/part-{number}"), path(f"{top}/{number}"))
        for old in numbers()[:-2]:
            files.delete(path(f"{top}/{old}"), True)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(stream: DataFrame, model, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the model's transform of a stream to Parquet files: a projection, without state."""
    writer = model.transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
