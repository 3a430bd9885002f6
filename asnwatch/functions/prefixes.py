"""IP prefixes as bit strings: the first ``prefix_len`` bits of the address, most significant first.

Two prefixes are the same network if family and bit string agree, and one covers another if its bit
string begins the other's, so every prefix relation is an equality on strings that Spark can hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"
V6 = r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])$"


def _v4_bits(address: Column) -> Column:
    """The 32 bits of four octets, by way of the number that they are."""
    octets = [F.substring_index(F.substring_index(address, ".", i), ".", -1).try_cast("bigint") for i in (1, 2, 3, 4)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    return F.lpad(F.bin(number), 32, "0")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _v6_bits(address: Column) -> Column:
    """128 bits, null if the text is no IPv6 address. A dotted tail counts as two groups."""

    def with_hex_tail(tail: Column) -> Column:
        word = lambda bits, start: F.lower(F.conv(F.substring(bits, start, 16), 2, 16))
        in_hex = _let(_v4_bits(tail), lambda bits: F.concat(word(bits, 1), F.lit(":"), word(bits, 17)))
        return F.when(tail != "", F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), in_hex)).otherwise(address)

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(halves: Column) -> Column:
        sides = F.struct(F.size(halves).alias("n"), groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"))
        return _let(sides, joined)

    def joined(s: Column) -> Column:
        n = F.size(s["left"]) + F.size(s["right"])
        whole = ((s["n"] == 1) & (n == 8)) | ((s["n"] == 2) & (n <= 7))
        return F.when(whole, F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), s["right"]))

    def bits(g: Column) -> Column:
        return F.when(F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), ""))

    plain = _let(F.regexp_extract(address, rf"({_OCTET}(?:\.{_OCTET}){{3}})$", 1), with_hex_tail)
    return _let(_let(F.split(plain, "::", -1), filled), bits)


def address_bits(prefix: Column) -> Column:
    """All bits of the prefix's address text, host bits included; null for anything but a prefix."""
    address = F.substring_index(prefix, "/", 1)
    return F.when(prefix.rlike(V4), _v4_bits(address)).when(prefix.rlike(V6), _v6_bits(address))


def is_prefix(prefix: Column) -> Column:
    """Whether a text is a prefix; the bits of an IPv4 prefix need not be worked out for that."""
    long = F.when(prefix.rlike(V6), _v6_bits(F.substring_index(prefix, "/", 1)).isNotNull())
    return F.coalesce(F.when(prefix.rlike(V4), True).otherwise(long), F.lit(False))


def normalise_prefixes(df: DataFrame, column: str = "prefix") -> DataFrame:
    """Add ``family`` (4 or 6), ``prefix_len`` and ``net_key`` (host bits cut off); all null for a bad prefix."""
    bits = address_bits(F.col(column))
    parsed = df.withColumn("_bits", bits)
    ok = F.col("_bits").isNotNull()
    length = F.when(ok, F.substring_index(column, "/", -1).cast("int"))
    return parsed.withColumns({
        "family": F.when(ok, F.when(F.length("_bits") == 32, 4).otherwise(6)).cast("tinyint"),
        "prefix_len": length,
        "net_key": F.substring(F.col("_bits"), F.lit(1), length),
    }).drop("_bits")


def network_key(net_key: Column, family: Column) -> Column:
    """The network address as a key of full width, zeros behind the prefix."""
    return F.rpad(net_key, F.when(family == 4, 32).otherwise(128), "0")
