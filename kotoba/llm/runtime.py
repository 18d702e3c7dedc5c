"""What every operator of this subpackage shares: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python works on slices of an Arrow batch that hold at most so many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch: bounds the memory of a batch of ordinary documents.
BATCH_ROWS = 2000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone so that any path it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as a row may hold a very long text. Plans read the setting when they run, so it stays;
    it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is set: a temporary one if all runs on this
    machine, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        folder = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="kotoba-")
        shared_folder.own = folder
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kotoba-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables of written() there are."""
    return len(_written)


def clean(since: int = 0, but: int = 0) -> None:
    """Deletes the tables that written() has made, from number `since` on and but for the latest ones if asked so. What is
    read from them must be over by then."""
    gone = _written[since : len(_written) - but]
    del _written[since : since + len(gone)]
    for spark, path in reversed(gone):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be over
            return


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts sum up to limit bytes, or of one row."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands fn one bounded slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return run


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for columns of our own next to those of df, none of which they are (in any case)."""
    taken = {c.lower() for c in df.columns}
    tail = next(t for t in ("", *(f"_{k}" for k in range(len(taken) * len(names) + 1))) if not any(f"__{n}{t}".lower() in taken for n in names))
    return tuple(f"__{n}{tail}" for n in names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
