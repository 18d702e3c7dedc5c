"""Texts from lines, words and tags to JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def valid_text(text: Column) -> Column:
    """The text; bytes that aren't UTF-8 stop the query."""
    return F.validate_utf8(text)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text a line (column text). Only a line feed ends a line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(valid_text(F.col("value")).alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a category, a text, its words and their labels; blank lines are passed over."""
    schema = "cat string, text string, words array<string>, postags array<string>"
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def as_json(value: Column | str) -> Column:
    """Words as a JSON array, tagged text as an object."""
    return F.to_json(value)


def write_json(df: DataFrame, column: str, path: str) -> None:
    """One JSON value a line."""
    df.select(as_json(column).alias("value")).write.text(path)
