"""What late rows change in tables that a stream has written: only results of keys, and from times, that they touch are worked
out again, from the archive of all rows, and replaced. The tables then are what a batch run over the archive gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asnwatch.operators import detect, feed, topology
from asnwatch.operators.spread import SPREAD_US, stored

_VANTAGE = ["prefix", "peer_asn"]


def repair_edges(changes: DataFrame, observations: DataFrame, late: DataFrame, as_of_us: int, ttl_us: int = topology.TTL_US, sweep_us: int = topology.SWEEP_US, spread_us: int = SPREAD_US) -> DataFrame:
    """``changes`` (kind, a, b, event_us) of a stream of edges with those replaced that belong to an edge in ``late``.
    ``observations`` are all of the archive, late ones included."""
    touched = stored(topology.canonical_edge(late).select("lo", "hi").distinct())
    kept = topology.canonical_edge(changes.select("kind", "a", "b", "event_us")).join(touched, ["lo", "hi"], "left_anti").drop("lo", "hi")
    again = stored(topology.edge_episodes(observations.join(touched, ["lo", "hi"], "left_semi"), ttl_us, sweep_us, as_of_us, spread_us))
    up = topology.link_up(again).select(F.lit(feed.LINK_UP).alias("kind"), "a", "b", "event_us")
    return kept.union(up).union(topology.link_down(again).select(F.lit(feed.LINK_DOWN), "a", "b", "event_us"))


def repair_churn(judged: DataFrame, fired: DataFrame, ops: DataFrame, late: DataFrame, window_us: int = detect.CHURN_WINDOW_US, spread_us: int = SPREAD_US, **parameters) -> DataFrame:
    """``fired`` of a stream of churn with all from the first late row on replaced. Counts are made anew for the vantages in
    ``late`` (operations), from ``ops``, the archive with them; the others' come from ``judged``, the counts and thresholds
    that ``churn_batches`` has kept. Thresholds, which look at all vantages, are made anew from the first late row on,
    with the counts that they look back on; episodes that go on into that time are known by the thresholds before it."""
    late = late.filter("op = 'A' and peer_asn is not null")
    start = late.agg(F.min("event_us")).first()[0]
    if start is None:
        return fired
    baseline, least = parameters.get("baseline", detect.BASELINE), parameters.get("min_updates", detect.MIN_UPDATES)
    columns = ["msg_id", "event_us", "pos", *_VANTAGE, "n_updates"]
    touched = stored(late.select(*_VANTAGE).distinct())
    again = detect.vantage_counts(ops.join(touched, _VANTAGE, "left_semi"), window_us, spread_us).select(columns)
    counts = stored(judged.select(columns).join(touched, _VANTAGE, "left_anti").unionByName(again))
    order = [F.desc(c) for c in ("event_us", "msg_id", "pos")]
    before = counts.filter(F.col("event_us") < start).orderBy(*order).limit(baseline)
    recent = counts.filter(F.col("event_us") >= start).union(before)
    fresh = stored(detect.churn_threshold(recent, **parameters).filter(F.col("event_us") >= start))
    early = judged.filter(F.col("event_us") < start).withColumn("above", detect.above_threshold(least))
    running = early.groupBy(*_VANTAGE).agg(F.max_by("above", F.struct("event_us", "msg_id", "pos")).alias("above")).filter("above").select(*_VANTAGE)
    found = detect.detect_churn(fresh, least, running, spread_us)
    return fired.filter(F.col("event_us") < start).unionByName(found.select(fired.columns))
