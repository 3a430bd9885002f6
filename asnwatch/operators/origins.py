"""Origins of prefixes: what each announcement shows against those before it, and current tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asnwatch.operators.routes import SEQUENCE
from asnwatch.operators.spread import SPREAD_US, bucketed, met, openings, stored

#: Origins that are remembered of one prefix.
MOST_ORIGINS = 16
_KEY = ("family", "net_key")


def apply_withdrawals(ops: DataFrame, spread_us: int | None = SPREAD_US) -> DataFrame:
    """Add ``segment``: how often the prefix was withdrawn so far. A withdrawal by any peer forgets it. A network's
    history is spread over buckets of ``spread_us``, if that is not None."""
    gone = (F.col("op") == "W").cast("int")
    if spread_us is None:
        return ops.withColumn("segment", F.sum(gone).over(Window.partitionBy(*_KEY).orderBy(*SEQUENCE)))
    timed = bucketed(ops, spread_us)
    within = Window.partitionBy(*_KEY, "_bucket").orderBy(*SEQUENCE)
    opened = met(timed, openings(timed, list(_KEY), gone), [*_KEY, "_bucket"], "left")
    return opened.withColumn("segment", F.coalesce("_opening", F.lit(0)) + F.sum(gone).over(within)).drop("_opening", "_bucket")


def origin_observations(ops: DataFrame, suppress_saturated: bool = False, spread_us: int | None = SPREAD_US) -> DataFrame:
    """For each announcement with an origin: the origin before it, whether it is a change to an origin not
    remembered, and the number of remembered origins.

    Once MOST_ORIGINS are remembered no more are added, so a further origin counts as a change each time
    it comes; with ``suppress_saturated`` only the first time. One network may hold a large part of all rows:
    ``spread_us`` cuts each network's history into buckets of that time, which go to different tasks and open with
    what the buckets before them came to. With None all windows share one shuffle by network."""
    rows = _in_one(ops) if spread_us is None else _spread(ops, spread_us)
    again = F.lit(False) if suppress_saturated else F.col("origin_rank") > MOST_ORIGINS
    return rows.select(
        "msg_id", "event_us", "pos", "prefix", "family", "prefix_len", "net_key", "peer_asn", "previous_origin", F.col("origin_asn").alias("new_origin"),
        (F.col("previous_origin").isNotNull() & (F.col("first") | again)).alias("changed"),
        F.least(F.col("rank"), F.lit(MOST_ORIGINS)).cast("int").alias("distinct_origins"),
    )


def _in_one(ops: DataFrame) -> DataFrame:
    """Add previous_origin, first (whether the origin is new in its segment), rank (origins so far) and
    origin_rank (place of the origin among them), by windows over whole segments."""
    rows = apply_withdrawals(ops, None).filter("op = 'A' and origin_asn is not null")
    key = [*_KEY, "segment"]
    order = Window.partitionBy(*key).orderBy(*SEQUENCE)
    same = Window.partitionBy(*key, "origin_asn").orderBy(*SEQUENCE)
    rows = rows.withColumn("previous_origin", F.lag("origin_asn").over(order)).withColumn("first", F.row_number().over(same) == 1)
    rows = rows.withColumn("rank", F.sum(F.col("first").cast("int")).over(order))
    return rows.withColumn("origin_rank", F.min("rank").over(Window.partitionBy(*key, "origin_asn")))


def _spread(ops: DataFrame, spread_us: int) -> DataFrame:
    """The same from windows within buckets of a segment. What a row needs to know of other buckets comes from aggregates: a row
    for each origin that a bucket meets has its first and last sight there; from these follow the origin's place in its
    segment, and what the buckets before came to. Rows are joined by (network, segment, bucket, origin), never by
    network or origin alone, so that a network with one origin for ever is spread as well."""
    key = [*_KEY, "segment"]
    within = [*key, "bucket"]
    rows = stored(apply_withdrawals(ops, spread_us).filter("op = 'A' and origin_asn is not null").withColumn("bucket", F.expr(f"event_us div {spread_us}L")))

    seq = F.struct(*SEQUENCE)
    # Sights are dealt out by segment once, for all windows below; what the buckets before came to is a window over them too.
    sights = rows.groupBy(*within, "origin_asn").agg(F.min(seq).alias("seen"), F.max(seq).alias("last")).repartition(*key)
    sights = sights.withColumn("first_seq", F.min("seen").over(Window.partitionBy(*key, "origin_asn")))
    placed = sights.withColumn("origin_rank", F.dense_rank().over(Window.partitionBy(*key).orderBy("first_seq")))
    earlier = Window.partitionBy(*key).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    known = placed.select(
        *within, "origin_asn", "first_seq", "origin_rank", F.max_by("origin_asn", "last").over(earlier).alias("before_origin"),
        F.coalesce(F.max(F.when(F.col("seen") == F.col("first_seq"), F.col("origin_rank"))).over(earlier), F.lit(0)).alias("before_rank"),
    )
    joined = met(rows, known, [*within, "origin_asn"]).withColumn("first", seq == F.col("first_seq")).drop("first_seq")
    order = Window.partitionBy(*within).orderBy(*SEQUENCE)
    return joined.withColumns({
        "previous_origin": F.coalesce(F.lag("origin_asn").over(order), F.col("before_origin")),
        "rank": F.greatest(F.col("before_rank"), F.max(F.when(F.col("first"), F.col("origin_rank"))).over(order)),
    })


def prefix_origins(ops: DataFrame, as_of_us: int | None = None, spread_us: int | None = SPREAD_US) -> DataFrame:
    """Networks announced and not withdrawn since: current origin and the remembered ones, in order of first
    sight. Of each segment a row for each origin is gathered, of which those of the last segment stay."""
    if as_of_us is not None:
        ops = ops.filter(F.col("event_us") <= as_of_us)
    seq = F.struct(*SEQUENCE)
    each = apply_withdrawals(ops, spread_us).groupBy(*_KEY, "prefix_len", "segment", "origin_asn").agg(F.min(seq).alias("first"), F.max(seq).alias("last"))
    newest = each.withColumn("newest", F.max("segment").over(Window.partitionBy(*_KEY))).filter("segment = newest and origin_asn is not null")
    ranked = newest.withColumn("place", F.row_number().over(Window.partitionBy(*_KEY).orderBy("first")))
    return ranked.groupBy(*_KEY, "prefix_len").agg(
        F.max_by("origin_asn", "last").alias("origin"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= MOST_ORIGINS, F.struct("place", "origin_asn")))), lambda x: x["origin_asn"]).alias("origins"),
    )
