"""Streams of lines: stateless projections, so there is nothing to keep between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.lines import as_json, valid_text


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that arrive in a folder (column text)."""
    return spark.readStream.option("lineSep", "\n").text(path).select(valid_text(F.col("value")).alias("text"))


def stream_json(texts: DataFrame, fn: Callable[[Column], Column], path: str, checkpoint: str) -> StreamingQuery:
    """fn of each text as one JSON value a line; ends when what has arrived is done."""
    made = texts.select(as_json(fn(F.col("text"))).alias("value"))
    return made.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
