"""Shared helpers: running batch functions over texts, splits by document id, samples."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A slice of an Arrow batch holds at most so many rows and, unless one row is longer, bytes of text.
SLICE_ROWS = 4096
SLICE_BYTES = 8 << 20
#: Rows of an Arrow batch of wide rows, and of small rows that one task takes when few are dealt anew.
WIDE_ROWS = 512
TASK_ROWS = 50_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay within ``most`` bytes."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = int(np.searchsorted(total, before + most, side="right"))
        end = min(max(end, start + 1), start + SLICE_ROWS)
        yield batch.slice(start, end - start)
        start = end


#: What this Python worker keeps for its next tasks, one large object at most.
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """The object of that name that this worker keeps, made if it keeps none or another one."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text: str = "text", most: int = SLICE_BYTES, holds: str = "") -> DataFrame:
    """mapInArrow over slices of bounded size. ``make`` runs once for each task and returns the
    batch function, which maps a record batch to columns in the order of ``schema``. What a worker keeps
    from another operator than the one that ``holds`` it is dropped first."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if holds not in _held:
            _held.clear()
        each = make()
        for batch in batches:
            for part in slices(batch, text, most):
                out = each(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in kind], schema=kind)
        del each
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give what a task has freed back to the system: its worker waits for the next task and may serve another operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = WIDE_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows at most, in no more tasks than these need at ``each``: every task of a map
    side leaves files. Tables of many rows stay as they are."""
    return df.coalesce(max(1, -(-rows // each)))


def ddl(df: DataFrame, columns: list[str]) -> str:
    """The named columns of ``df`` as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null ones as empty strings."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_bucket(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def hash_fraction(column: str) -> Column:
    """A number in [0, 1) that depends on the value of ``column`` only."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(17)), 11) / F.lit(float(1 << 53))


def sample_to(df: DataFrame, bound: int, column: str = "doc_id") -> DataFrame:
    """Rows chosen by a hash of ``column``, all of them or about 0.95 * bound; the choice is the same in every run."""
    n = df.count()
    return df if n <= bound else df.filter(hash_fraction(column) < 0.95 * bound / n)


def largest(df: DataFrame, column: str, bound: int) -> DataFrame:
    """Rows with the largest positive values of ``column``, ``bound`` at most, cut where values are at least 4 %
    apart (none if more rows than that have the largest ones); callers treat the others exactly. Only a histogram of some hundred rows reaches the driver, so the size of ``df`` does not matter."""
    step = F.floor(F.log2(column) * 16)
    sizes = df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, cut = 0, None
    for r in sizes:
        total += r["n"]
        if total > bound:
            break
        cut = r["step"]
    return df.filter(step >= cut) if cut is not None else df.filter(F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="asnwatch-"))
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["checkpointed", "ddl", "few_tasks", "hash_fraction", "held", "id_bucket", "largest", "map_texts", "read", "release", "sample_to", "slices", "small_batches", "texts_of"]
