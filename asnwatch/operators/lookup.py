"""Longest-prefix match as an equality join on the beginnings of bit strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table rows up to this number are broadcast (a row is under 1 KB); larger tables are joined by shuffle.
BROADCAST_ROWS = 20_000


def _match(probes: DataFrame, key: Column, table: DataFrame, values: list[str]) -> DataFrame:
    """Probes with the values of the most specific entry whose key begins the probe's; null if none does.
    Candidate lengths are those in the table, 33 and 129 at most."""
    sizes = {r[0]: r[1] for r in table.groupBy("prefix_len").count().collect()}
    lengths = sorted(sizes)
    # The distinct keys are looked up, not the probes: many probes share a network.
    keys = probes.select("family", key.alias("_key")).filter("_key is not null").distinct()
    tried = keys.withColumn("_len", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).filter(F.col("_len") <= F.length("_key"))
    entries = table.select("family", F.col("net_key").alias("_part"), F.struct("prefix_len", *values).alias("_value"))
    side = F.broadcast(entries) if sum(sizes.values()) <= BROADCAST_ROWS else entries
    hits = tried.withColumn("_part", F.substring("_key", F.lit(1), F.col("_len"))).join(side, ["family", "_part"])
    best = hits.groupBy("family", "_key").agg(F.max_by("_value", "_len").alias("_best"))
    found = probes.withColumn("_key", key).join(best, ["family", "_key"], "left")
    return found.select(*probes.columns, F.col("_best.prefix_len").alias("matched_len"), *[F.col(f"_best.{v}").alias(v) for v in values])


def longest_prefix_match(probes: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """``probes`` and ``table`` have family and net_key; an entry may equal the probe, and /0 covers all."""
    return _match(probes, F.col("net_key"), table, values)


def address_match(probes: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """As above for the probe's network address, so entries longer than the probe match too."""
    from asnwatch.functions.prefixes import network_key

    return _match(probes, network_key(F.col("net_key"), F.col("family")), table, values)
