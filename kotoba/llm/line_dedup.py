"""Operator 2: line dedup by overlapping three-line windows.

A window is three consecutive lines that have words (blank lines are passed over, white space at a line's ends does
not count). Windows are hashed to 128 bits; those found at two places or more are repeated; of a repeated window the
first place (by doc_id, then place in the text) stays, and the lines under every later one go. Windows overlap, so
the lines to remove are the union of covered positions. The first place of a line's content is never covered: its
window's first occurrence would hold that content earlier.

The first place of a window is found by an aggregate with partial sums before the shuffle, so a window that a third of
all documents hold is a few rows by then; the join that marks later places splits what is skewed (AQE) as both its
sides are read from storage.

Defined results: a null text stays null; texts of fewer than three lines with words lose none; rows with the same id
and text are one document and get the same result each; rows with the same id and other texts are told apart by the
text's hash, which also orders them; extra columns stay, but for one named as the column of results, which is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches, fresh, per_slice, table, written

WINDOW = 3
BLANK = " \t\n\x0b\x0c\r"


def lines_with_words(text: str | None) -> list[tuple[int, str]]:
    """Number and stripped content of the lines that have words."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip(BLANK))]


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, rows, at = [], [], []
    for row, text in enumerate(batch.column("text").to_pylist()):
        lines = [s.encode() for _, s in lines_with_words(text)]
        for i in range(len(lines) - WINDOW + 1):
            hashes.append(hashlib.blake2b(b"\n".join(lines[i : i + WINDOW]), digest_size=16).digest())
            rows.append(row)
            at.append(i)
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at, pa.int32())], ["h", "doc_id", "th", "at"])


def window_places(keyed: DataFrame) -> DataFrame:
    """(h, doc_id, th, at) for each window of each row of (doc_id, th, text)."""
    return keyed.mapInArrow(per_slice(_windows), "h binary, doc_id long, th long, at int")


def covered_lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, th, starts): the windows of a document, by the number of their first line among those with words,
    that stand somewhere earlier too."""
    place = F.struct("doc_id", "th", "at")
    first = window_places(keyed).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = written(first.where("first != last").select("h", "first"), "repeated-windows")
    later = window_places(keyed).join(repeated, "h").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """docs with text without its repeated lines, and a column with the numbers (from 0) of the lines removed."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    mark_id, mark_th, mark_starts = fresh(docs, "id", "th", "starts")
    marks = covered_lines(keyed).select(F.col("doc_id").alias(mark_id), F.col("th").alias(mark_th), F.col("starts").alias(mark_starts))
    kept = [c for c in docs.columns if c != removed]
    joined = docs.select(*kept).join(marks, F.col(doc_id).cast("long").eqNullSafe(F.col(mark_id)) & (F.xxhash64(F.col(text)) == F.col(mark_th)), "left")
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(removed, T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = [], []
        for value, starts in zip(batch.column(text).to_pylist(), batch.column(mark_starts).to_pylist(), strict=True):
            if not starts:
                texts.append(value)
                gone.append([])
                continue
            numbers = np.array([i for i, _ in lines_with_words(value)])
            mark = np.zeros(len(numbers) + WINDOW, np.int64)
            np.add.at(mark, np.array(starts), 1)
            np.add.at(mark, np.array(starts) + WINDOW, -1)
            out = numbers[np.cumsum(mark)[: len(numbers)] > 0].tolist()
            drop = set(out)
            texts.append("\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop))
            gone.append(out)
        columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.int32()))], [*kept, removed])

    return joined.mapInArrow(per_slice(run, text), schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), "text")


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, n, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS h FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), later AS (
  SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, n) AS k FROM windows WHERE h IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT DISTINCT w.doc_id, w.i FROM later l JOIN worded w ON w.doc_id = l.doc_id AND w.n BETWEEN l.n AND l.n + 2
), kept AS (
  SELECT l.doc_id, count(g.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
