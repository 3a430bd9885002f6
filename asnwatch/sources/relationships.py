"""AS relationship files: lines ``a|b|rel``, rel -1 if a is the provider of b, 0 if they are peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asnwatch.functions.messages import as_number, once
from asnwatch.schemas import RELATIONSHIPS

_SNAPSHOT = r"(?:^|/)([0-9]{8})\.as-rel2?\.txt\.bz2$"


def parse_as_relationships(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """(a, b, rel) with rel seen from a: provider or peer. Comments and bad lines are skipped, further
    columns ignored, and of lines for the same (a, b) the last counts."""
    line = F.trim(value)
    part = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    rows = once(lines, _part=F.when(~line.startswith("#"), part)).select(F.col("_part"), F.col(line_no).alias("_line"))
    field = lambda k: F.get("_part", F.lit(k))
    # Whether a is the provider is a truth value, which is gathered in place, unlike a text.
    parsed = once(rows, a=as_number(field(0)), b=as_number(field(1)), _above=F.when(field(2) == "-1", True).when(field(2) == "0", False))
    last = parsed.filter("a is not null and b is not null and _above is not null").groupBy("a", "b").agg(F.max_by("_above", "_line").alias("_above"))
    return last.select("a", "b", F.when(F.col("_above"), "provider").otherwise("peer").alias("rel"))


def read_as_relationships(spark: SparkSession, path: str) -> DataFrame:
    """One file, plain or bz2. Line numbers are taken as the file is read, which keeps its order."""
    return parse_as_relationships(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def with_both_directions(relationships: DataFrame) -> DataFrame:
    """Every pair as seen from either side. What a line says of (a, b) precedes the inverse of (b, a)."""
    inverse = relationships.select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.when(F.col("rel") == "provider", "customer").when(F.col("rel") == "customer", "provider").otherwise(F.col("rel")).alias("rel"), F.lit(1).alias("turn")
    )
    both = relationships.select("a", "b", "rel", F.lit(0).alias("turn")).union(inverse)
    first = Window.partitionBy("a", "b").orderBy("turn")
    return both.withColumn("place", F.row_number().over(first)).filter("place = 1").select("a", "b", "rel")


def snapshot_date(file: str = "file"):
    """The date in a dataset file's name, null for files of another kind (also IPv6 ones)."""
    return F.to_date(F.nullif(F.regexp_extract(file, _SNAPSHOT, 1), F.lit("")), "yyyyMMdd")


def latest_relationship_snapshot(rows: DataFrame, as_of=None, file: str = "file") -> DataFrame:
    """Rows of the newest dataset file, not after ``as_of`` if that is given. ``file`` holds the file's name
    (``input_file_name()``). Only the newest date travels, as a one-row aggregate."""
    dated = rows.withColumn("snapshot", snapshot_date(file)).filter("snapshot is not null")
    if as_of is not None:
        dated = dated.filter(F.col("snapshot") <= F.lit(as_of).cast("date"))
    newest = dated.agg(F.max("snapshot").alias("snapshot"))
    return dated.join(F.broadcast(newest), "snapshot", "left_semi")  # one row


def empty_relationships(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RELATIONSHIPS)
