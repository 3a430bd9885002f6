"""Histories of a key cut into buckets of time, so that one busy key is spread over tasks.

A bucket opens with what those before it came to: aggregates of a row for each key and bucket, which are
summed or looked up, and joined back to the rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of a bucket unless the caller knows better.
SPREAD_US = 3_600_000_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder in spark.checkpoint.dir, for what reads it more than once. Without
    such a folder, and for a stream, it stays a plan."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None or df.isStreaming:
        return df
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def side_by_side(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """What each of ``makers`` returns, made in threads of their own, so that the jobs that they run share the cluster."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(m)) for m in makers]]


def met(rows: DataFrame, side: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a side that may grow with them, by shuffle whatever its size is estimated at: estimates of what comes
    out of parsed texts are far too low, and a side broadcast for that has to pass the driver."""
    return rows.join(side.hint("merge"), on, how)


def bucketed(rows: DataFrame, spread_us: int) -> DataFrame:
    """Add ``_bucket``."""
    return rows.withColumn("_bucket", F.expr(f"event_us div {spread_us}L"))


def openings(bucketed_rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """(key, _bucket, _opening): the sum of ``value`` over the key's rows in all buckets before."""
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed_rows.groupBy(*key, "_bucket").agg(F.sum(value).alias("_sum"))
    return sums.select(*key, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_opening"))


def lagged(rows: DataFrame, key: list[str], order: list[str], spread_us: int = SPREAD_US, **columns: Column) -> DataFrame:
    """Add for each of ``columns`` its value in the key's row before, null in the first one. Rows are read twice: those
    that cost much should be ``stored``."""
    timed = bucketed(rows, spread_us)
    last = timed.groupBy(*key, "_bucket").agg(F.max_by(F.struct(*[c.alias(n) for n, c in columns.items()]), F.struct(*order)).alias("_ends"))
    before = last.select(*key, "_bucket", F.lag("_ends").over(Window.partitionBy(*key).orderBy("_bucket")).alias("_carried"))
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    first = F.row_number().over(within) == 1
    return met(timed, before, [*key, "_bucket"]).withColumns({n: F.when(first, F.col(f"_carried.{n}")).otherwise(F.lag(c).over(within)) for n, c in columns.items()}).drop("_bucket", "_carried")


def drop_versions(spark: SparkSession, path: str, number: int, versions: int = 3) -> None:
    """Of a table with a version a batch under ``path``, keep the last ``versions``, up to the one of batch ``number``. A
    replay of a batch needs the one before it."""
    if number >= versions:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - versions}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
