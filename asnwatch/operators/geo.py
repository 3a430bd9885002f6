"""Regions of prefixes and of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.operators.lookup import address_match

#: Weight of low, medium and high severity.
SEVERITY_INDEX = (0.33, 0.66, 1.0)


def resolve_region(df: DataFrame, geo_blocks: DataFrame) -> DataFrame:
    """Add ``region`` by the network address: country and subdivision, or country alone, else null."""
    found = address_match(df, geo_blocks, ["country", "subdivision"])
    region = F.when(F.col("country").isNotNull(), F.concat_ws("-", "country", "subdivision"))
    return found.withColumn("region", region).drop("matched_len", "country", "subdivision")


def resolve_asn(df: DataFrame, asn_blocks: DataFrame) -> DataFrame:
    """Add ``asn``, the one registered for the network address."""
    return address_match(df, asn_blocks, ["asn"]).drop("matched_len")


def with_severity_index(anomalies: DataFrame) -> DataFrame:
    """Add ``severity_index``: the weight of severity 0, 1 or 2 from 0 to 1."""
    index = F.get(F.array(*[F.lit(x) for x in SEVERITY_INDEX]), F.col("severity").cast("int"))
    return anomalies.withColumn("severity_index", F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0)).cast("float"))


def area_degraded(anomalies: DataFrame, geo_blocks: DataFrame) -> DataFrame:
    """Anomalies whose prefix resolves to a region, with region and weight. Leaks have no prefix."""
    rows = anomalies.filter("prefix is not null")
    if "net_key" not in rows.columns:
        rows = normalise_prefixes(rows)
    return with_severity_index(resolve_region(rows, geo_blocks)).filter("region is not null")
