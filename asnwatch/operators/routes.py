"""Announcements and withdrawals: messages to one row an operation, and filters on messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asnwatch.functions.messages import origin_asn
from asnwatch.functions.prefixes import address_bits, normalise_prefixes

#: The total order of operations.
SEQUENCE = ("event_us", "msg_id", "pos")
_KEPT = ("msg_id", "event_us", "peer_asn")


def _announced(announcements: Column) -> Column:
    return F.flatten(F.transform(announcements, lambda a: F.coalesce(a["prefixes"], F.array().cast("array<string>"))))


def with_origin_asn(updates: DataFrame) -> DataFrame:
    return updates.withColumn("origin_asn", origin_asn(F.col("path")))


def announced_prefixes(updates: DataFrame) -> DataFrame:
    """A row for each announced prefix, in the order of the message."""
    return updates.select(*_KEPT, origin_asn(F.col("path")).alias("origin_asn"), F.posexplode(_announced(F.col("announcements"))).alias("pos", "prefix"))


def withdrawn_prefixes(updates: DataFrame) -> DataFrame:
    """A row for each withdrawn prefix; places follow those of the message's announcements."""
    return updates.select(*_KEPT, F.lit(None).cast("bigint").alias("origin_asn"), F.size(_announced(F.col("announcements"))).alias("before"), F.posexplode("withdrawals").alias("place", "prefix")).select(
        *_KEPT, "origin_asn", (F.col("before") + F.col("place")).alias("pos"), "prefix"
    )


def route_ops(updates: DataFrame) -> DataFrame:
    """All operations with parsed prefixes: op A or W, announcements before withdrawals. The messages are read
    once: both kinds come out of one array. Of a stream they keep event_ts, the time of its watermark."""
    kept = [*_KEPT, "event_ts"] if updates.isStreaming else _KEPT
    items = F.concat(
        F.transform(_announced(F.col("announcements")), lambda p: F.struct(F.lit("A").alias("op"), p.alias("prefix"))),
        F.transform(F.col("withdrawals"), lambda p: F.struct(F.lit("W").alias("op"), p.alias("prefix"))),
    )
    rows = updates.select(*kept, origin_asn(F.col("path")).alias("origin"), F.posexplode(items).alias("pos", "item"))
    ops = rows.select(*kept, "pos", "item.op", "item.prefix", F.when(F.col("item.op") == "A", F.col("origin")).alias("origin_asn"))
    return normalise_prefixes(ops)


def filter_collector(updates: DataFrame, host: str) -> DataFrame:
    return updates.filter(F.col("host") == host)


def filter_path_asn(updates: DataFrame, asn: int) -> DataFrame:
    """Messages whose path goes through an ASN."""
    return updates.filter(F.array_contains("path", F.lit(asn).cast("bigint")))


def filter_prefix(updates: DataFrame, prefix: str | None, more_specific: bool = False, less_specific: bool = False) -> DataFrame:
    """Messages that announce or withdraw a network, with the flags also networks inside it or around it.
    Without a prefix the flags mean nothing. A bad prefix raises ValueError before anything runs.
    Decided in each message's own arrays, so nothing is exploded or shuffled."""
    if prefix is None:
        return updates
    found = normalise_prefixes(updates.sparkSession.createDataFrame([(prefix,)], "prefix string")).first()
    if found["net_key"] is None:
        raise ValueError(f"not a prefix: {prefix}")
    wanted, width = found["net_key"], 32 if found["family"] == 4 else 128

    def hit(p: Column) -> Column:
        bits = address_bits(p)
        key = F.substring(bits, F.lit(1), F.substring_index(p, "/", -1).cast("int"))
        same = key == wanted
        if more_specific:
            same = same | key.startswith(wanted)
        if less_specific:
            same = same | F.lit(wanted).startswith(key)
        return F.coalesce((F.length(bits) == width) & same, F.lit(False))

    return updates.filter(F.exists(F.concat(_announced(F.col("announcements")), F.col("withdrawals")), hit))
