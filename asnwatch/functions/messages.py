"""Fields of a feed message: AS paths, ASNs, message types, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_ASN = 4_294_967_295
MESSAGE_TYPES = ("UPDATE", "OPEN", "NOTIFICATION", "KEEPALIVE", "RIS_PEER_STATE")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator of one row, so that they are worked out once, however often they are used:
    the optimiser neither copies them into filters nor into each other."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def as_number(text: Column) -> Column:
    """An ASN from its decimal text, null if it is none."""
    number = F.when(text.rlike("^[0-9]{1,10}$"), text.try_cast("bigint"))
    return F.when(number <= LARGEST_ASN, number)


def flatten_as_path(path: Column) -> Column:
    """A path of ASN texts, sets in brackets, as one list of ASNs; null elements where a text is no ASN."""
    members = lambda x: F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ",")
    lists = F.transform(path, lambda x: F.when(F.trim(x) == "[]", F.array().cast("array<string>")).when(x.startswith("["), members(x)).otherwise(F.array(x)))
    return F.transform(F.flatten(lists), as_number)


def normalise_peer_asn(peer_asn: Column) -> Column:
    """A peer's ASN, written as number or text; null if absent or no ASN."""
    return as_number(F.trim(peer_asn))


def normalise_msg_type(msg_type: Column) -> Column:
    return F.when(msg_type.isin(*MESSAGE_TYPES), msg_type).otherwise("OTHER")


def origin_asn(path: Column) -> Column:
    """The last ASN of a path, null if the path is empty."""
    return F.try_element_at(path, F.lit(-1))


def event_us(timestamp: Column, fallback_us: Column) -> Column:
    """Microseconds of a collector timestamp in seconds; ``fallback_us`` unless it is positive."""
    return F.when(timestamp > 0, F.round(timestamp * 1_000_000).cast("bigint")).otherwise(fallback_us)
