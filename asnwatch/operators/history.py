"""The stored history of anomalies: rows, days, retention and queries."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.schemas import HISTORY

RETENTION_DAYS = 30
FILE_BYTES = 128 << 20
#: Rows of a page, the least that a lookup by prefix reads.
PAGE_ROWS = 4096
_LAYOUT = ("day", "family", "net_key", "observed_at")
MAX_BYTES = 2 << 30
_COLUMNS = [c.strip().split()[0] for c in HISTORY.replace("array<bigint>", "array").split(",")]


def with_day(df: DataFrame, observed_at: str = "observed_at") -> DataFrame:
    """Add ``day``, the date in the session's zone, which should be UTC."""
    return df.withColumn("day", F.to_date(observed_at))


def to_history(anomalies: DataFrame) -> DataFrame:
    """Anomalies (with ``region`` if resolved) as history rows; columns that do not apply are null."""
    rows = anomalies.withColumn("observed_at", F.timestamp_micros("event_us"))
    if "region" not in rows.columns:
        rows = rows.withColumn("region", F.lit(None).cast("string"))
    return with_day(rows.withColumn("updates_in_window", F.when(F.col("updates_in_window") > 2_147_483_647, 2_147_483_647).otherwise(F.col("updates_in_window")).cast("int")).select(*_COLUMNS))


def write_history(history: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, a folder a day. Rows are dealt out by range and sorted by network within a day, so that a day gets few files, a large
    one several, and pages and row groups hold narrow ranges of networks, which lookups by prefix skip by their bounds."""
    dealt = history.repartitionByRange(*_LAYOUT).sortWithinPartitions(*_LAYOUT)
    dealt.write.partitionBy("day").mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def compact_history(spark: SparkSession, path: str, before, file_bytes: int = FILE_BYTES) -> int:
    """Write the days before the date ``before`` anew that have more files than their bytes need at ``file_bytes`` each, laid
    out as ``write_history`` does, and put them in the place of the old ones, day by day. Returns how many days."""
    rows = read_history(spark, path).filter(F.col("day") < F.lit(before).cast("date"))
    files = rows.select("day", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    sizes = files.groupBy("day").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))
    days = [r["day"] for r in sizes.filter(F.col("files") > F.ceil(F.col("bytes") / file_bytes)).collect()]  # a row a day
    if not days:
        return 0
    name = uuid.uuid4()
    fresh, old = f"{path}/_fresh-{name}", f"{path}/_old-{name}"  # readers pass over such folders
    write_history(rows.filter(F.col("day").isin(days)).select(*_COLUMNS, "day"), fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(hadoop.Path(old))
    for day in days:
        place, new, aside = (hadoop.Path(f"{x}/day={day}") for x in (path, fresh, old))
        if not (system.rename(place, aside) and system.rename(new, place)):
            raise OSError(f"cannot put day {day} in its place; what it held is in {old}")
    system.delete(hadoop.Path(old), True)
    system.delete(hadoop.Path(fresh), True)
    return len(days)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{HISTORY}, day date").parquet(path)


def day_manifest(history: DataFrame) -> DataFrame:
    """(day, bytes): what each day's files hold, from the files' own metadata."""
    files = history.select("day", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return files.groupBy("day").agg(F.sum("n").alias("bytes"))


def prune_by_age(manifest: DataFrame, now: Column, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Days to drop for age: those before today less the retention."""
    return manifest.filter(F.col("day") < F.date_sub(F.to_date(now), retention_days))


def prune_by_size(manifest: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Days to drop, oldest first, until the rest fits; the newest day always stays. The manifest has a row a day."""
    newest_first = Window.orderBy(F.desc("day"))
    kept = F.sum("bytes").over(newest_first.rowsBetween(Window.unboundedPreceding, 0)) <= max_bytes
    return manifest.withColumn("_kept", kept | (F.row_number().over(newest_first) == 1)).filter(~F.col("_kept")).drop("_kept")


def prune_outcome(manifest: DataFrame, now: Column, retention_days: int = RETENTION_DAYS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row: days dropped for age and size, bytes left. Size counts what age has left."""
    old = prune_by_age(manifest, now, retention_days).select("day")
    young = manifest.join(old, "day", "left_anti")
    large = prune_by_size(young, max_bytes).select("day")
    marked = manifest.join(old.union(large).withColumn("dropped", F.lit(True)), "day", "left")
    return marked.agg(F.count("dropped").alias("days_dropped"), F.coalesce(F.sum(F.when(F.col("dropped").isNull(), F.col("bytes"))), F.lit(0)).alias("bytes_left"))


def drop_days(spark: SparkSession, path: str, days: DataFrame) -> int:
    """Delete the folders of ``days``, a list of days. Returns how many there were."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    names = [r["day"] for r in days.select("day").collect()]  # a row a day
    for day in names:
        folder = hadoop.Path(f"{path}/day={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(names)


def history_query(history: DataFrame, prefix: str | None = None, kind: str | None = None, region: str | None = None, min_severity: int | None = None, since=None, until=None) -> DataFrame:
    """Rows by kind, region, severity, time from ``since`` to before ``until``, and networks that contain the
    prefix or lie in it. Times also bound ``day``, so that only those days' folders are read."""
    rows = history
    if since is not None:
        rows = rows.filter((F.col("observed_at") >= F.lit(since).cast("timestamp")) & (F.col("day") >= F.to_date(F.lit(since).cast("timestamp"))))
    if until is not None:
        rows = rows.filter((F.col("observed_at") < F.lit(until).cast("timestamp")) & (F.col("day") <= F.to_date(F.lit(until).cast("timestamp"))))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    if min_severity is not None:
        rows = rows.filter(F.col("severity") >= min_severity)
    if prefix is not None:
        found = normalise_prefixes(history.sparkSession.createDataFrame([(prefix,)], "prefix string")).first()
        if found["net_key"] is None:
            raise ValueError(f"not a prefix: {prefix}")
        key = found["net_key"]
        # Equalities one by one, as a long list would reach the files as one wide range.
        around = reduce(or_, [F.col("net_key") == key[:n] for n in range(len(key))], F.col("net_key").startswith(key))
        rows = rows.filter((F.col("family") == found["family"]) & around)
    return rows


def history_timeseries(history: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Anomalies and worst severity by kind and bucket of time."""
    grouped = history.groupBy(F.window("observed_at", bucket).alias("w"), "kind").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"))
    return grouped.select(F.col("w.start").alias("bucket_start"), "kind", "n", "max_severity")
