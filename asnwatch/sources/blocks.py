"""Published address block tables: regions and ASNs by network."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.schemas import ASN_BLOCKS, GEO_BLOCKS


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_geo_blocks(spark: SparkSession, path: str) -> DataFrame:
    """CSV of network, country, subdivision. An absent file gives no blocks, so that no region resolves."""
    rows = _csv(spark, path, "network string, country string, subdivision string")
    if rows is None:
        return spark.createDataFrame([], GEO_BLOCKS)
    return geo_blocks(rows)


def geo_blocks(rows: DataFrame) -> DataFrame:
    return normalise_prefixes(rows, "network").filter("net_key is not null").select("family", "prefix_len", "net_key", "country", "subdivision")


def read_asn_blocks(spark: SparkSession, path: str) -> DataFrame:
    """CSV of network and asn; an absent file gives no blocks."""
    rows = _csv(spark, path, "network string, asn bigint")
    if rows is None:
        return spark.createDataFrame([], ASN_BLOCKS)
    return normalise_prefixes(rows, "network").filter("net_key is not null").select("family", "prefix_len", "net_key", F.col("asn"))
