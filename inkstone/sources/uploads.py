"""Uploaded text files: bytes decoded with the first encoding that fits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb18030", "utf-16")


def decode(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding); (None, None) for null bytes and for what no encoding fits."""
    if data is None:
        return None, None
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return None, None


def decode_files(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, text, length, encoding): stripped text, its length before that, null text where no encoding fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x) for x in batch.column(1).to_pylist()]
            texts = [None if t is None else t.strip() for t, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t, _ in found], pa.int32()), pa.array([e for _, e in found], pa.string())], ["path", "text", "length", "encoding"])

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, text string, length int, encoding string")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """decode_files of all files of a folder that fit the pattern; files of no byte have no row."""
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))
