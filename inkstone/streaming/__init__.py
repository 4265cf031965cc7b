"""The same analyses on streams of documents.

Stages are row-wise column expressions, so a pipeline runs on a streaming frame as it is. Counts over event time close with
a watermark; repeated documents are dropped within it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline


def stream_pipeline(docs: DataFrame, pipeline: Pipeline, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the results of every document of a stream to Parquet files in `target`, exactly once."""
    return pipeline.run_batch(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stream_batches(docs: DataFrame, pipeline: Pipeline, checkpoint: str, progress: Callable[[int, int, int], None], target: str, trigger: dict | None = None) -> StreamingQuery:
    """As stream_pipeline, in micro-batches whose (number, succeeded, failed) are reported; a repeated batch overwrites its own files."""

    def each(batch: DataFrame, number: int) -> None:
        results = pipeline.run_batch(batch)
        results.write.mode("overwrite").parquet(f"{target}/batch={number}")
        counted = batch.sparkSession.read.parquet(f"{target}/batch={number}").agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
        progress(number, counted[0], counted[1])

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once_per_document(docs: DataFrame, id: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Repeated documents that come within the delay are dropped."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([id])


def term_trends(docs: DataFrame, words: str, time: str, window: str = "1 day", delay: str | None = "1 hour") -> DataFrame:
    """(window, term, count) of streaming documents with an array of words; a window closes when the watermark has passed it.

    delay: None for a stream that has a watermark already.
    """
    one = (docs.withWatermark(time, delay) if delay else docs).select(F.col(time).alias("t"), F.explode(words).alias("term"))
    return one.groupBy(F.window("t", window).alias("window"), "term").agg(F.count("*").alias("count"))
