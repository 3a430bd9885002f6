"""Detectors: origin hijacks, valley-free path leaks, and route churn against a robust threshold."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asnwatch.operators.routes import SEQUENCE
from asnwatch.operators.spread import SPREAD_US, lagged, met, stored
from asnwatch.operators.topology import degree_asof
from asnwatch.sources.relationships import with_both_directions

LOW, MEDIUM, HIGH = 0, 1, 2
LEAK_WINDOW_US = 60_000_000
DEGREE_RATIO = 4.0
CHURN_WINDOW_US = 10_000_000
MIN_UPDATES = 20
#: Counts that the churn threshold looks back on, and those needed before it does.
BASELINE = 1024
MIN_SAMPLES = 32
FLOOR = 20.0
DEVIATIONS = 6.0
#: Standard deviations of a normal distribution for one median absolute deviation.
MAD_SCALE = 1.4826
#: Relationship rows up to this number are broadcast (under 100 bytes each), above it joined by shuffle.
BROADCAST_ROWS = 500_000


def _severity(high: Column) -> Column:
    return F.when(high, HIGH).otherwise(MEDIUM).cast("smallint")


def detect_hijacks(observations: DataFrame) -> DataFrame:
    """Changes of origin; high from three remembered origins on."""
    return observations.filter("changed").withColumn("severity", _severity(F.col("distinct_origins") >= 3))


def _side(relationships: DataFrame) -> DataFrame:
    """Both directions of all relationships, stored, as they are counted and joined twice, and broadcast if they are few."""
    both = stored(with_both_directions(relationships))
    return F.broadcast(both) if both.count() <= BROADCAST_ROWS else both.hint("merge")


def relationship_lookup(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Add ``rel``, the role of a for b: provider, customer, peer or unknown."""
    return _known(pairs, _side(relationships))


def _known(pairs: DataFrame, side: DataFrame) -> DataFrame:
    return pairs.join(side, ["a", "b"], "left").withColumn("rel", F.coalesce("rel", F.lit("unknown")))


def _role(a: Column, b: Column, ratio: float) -> Column:
    """What an AS with degree ``a`` is for one with degree ``b``."""
    return F.when((a <= 0) | (b <= 0), "unknown").when(a >= b * ratio, "provider").when(b >= a * ratio, "customer").otherwise("peer")


def degree_relationship(pairs: DataFrame, degrees: DataFrame, ratio: float = DEGREE_RATIO) -> DataFrame:
    """Add ``rel`` by degrees (asn, degree): the ASN with ``ratio`` times the neighbours is the provider."""
    one = degrees.select(F.col("asn").alias("a"), F.col("degree").alias("_da"))
    two = degrees.select(F.col("asn").alias("b"), F.col("degree").alias("_db"))
    rel = _role(F.coalesce("_da", F.lit(0)), F.coalesce("_db", F.lit(0)), ratio)
    return met(met(pairs, one, "a", "left"), two, "b", "left").withColumn("rel", rel).drop("_da", "_db")


def resolve_relationships(pairs: DataFrame, relationships: DataFrame, degrees: DataFrame, ratio: float = DEGREE_RATIO) -> DataFrame:
    """By the dataset if it has any row, else by degrees; one choice for the whole run."""
    if relationships.isEmpty():
        return degree_relationship(pairs, degrees, ratio)
    return relationship_lookup(pairs, relationships)


def path_triples(updates: DataFrame, collapse_prepends: bool = False, *carry: str) -> DataFrame:
    """Each inner AS of each path: i from 1, y, the AS it learned the route from and the one it told, and the path."""
    walked = F.col("path")
    if collapse_prepends:
        walked = F.filter(walked, lambda x, i: (i == 0) | (F.get(F.col("path"), i - 1) != x))
    rows = updates.withColumn("walked", walked).filter(F.size("walked") >= 3)
    inner = F.transform(F.sequence(F.lit(1), F.size("walked") - 2), lambda i: F.struct(i.alias("i"), F.get("walked", i).alias("y"), F.get("walked", i + 1).alias("learned_from"), F.get("walked", i - 1).alias("told")))
    return rows.select("msg_id", "event_us", "path", *carry, F.inline(inner))


def _is_valley(rel_in: str, rel_out: str) -> Column:
    return F.col(rel_in).isin("customer", "peer") & F.col(rel_out).isin("customer", "peer")


def valley_apexes(updates: DataFrame, relationships: DataFrame, degrees: DataFrame | None = None, collapse_prepends: bool = False) -> DataFrame:
    """Inner ASes that pass a route from a provider or peer on to a provider or peer."""
    triples = path_triples(updates, collapse_prepends)
    if degrees is not None and relationships.isEmpty():
        role = lambda pairs: degree_relationship(pairs, degrees)
    else:
        side = _side(relationships)
        role = lambda pairs: _known(pairs, side)
    known = lambda df, b, out: role(df.withColumnsRenamed({"y": "a", b: "b"})).withColumnsRenamed({"a": "y", "b": b, "rel": out})
    both = known(known(triples, "learned_from", "rel_in"), "told", "rel_out")
    return both.filter(_is_valley("rel_in", "rel_out")).select("msg_id", "event_us", "path", "i", "y", "learned_from", "told")


def path_leaks(apexes: DataFrame) -> DataFrame:
    """One row for each message with an apex: the one nearest the origin, the number, severity, and the path.
    Apexes carry the path of their message, so the few messages that have any are not looked up again."""
    nearest = F.max_by(F.struct("y", "path"), "i").alias("nearest")
    per_message = apexes.groupBy("msg_id", "event_us").agg(nearest, F.count("*").cast("int").alias("violations"))
    return per_message.select("msg_id", "event_us", "nearest.path", F.col("nearest.y").alias("offending_asn"), "violations", _severity(F.col("violations") > 1).alias("severity"))


def valley_apexes_by_degree(updates: DataFrame, episodes: DataFrame, ratio: float = DEGREE_RATIO, collapse_prepends: bool = False, bucket_us: int = 3_600_000_000) -> DataFrame:
    """As ``valley_apexes``, roles by the degrees that the graph of ``episodes`` has at each message, its own new
    edges included. The degrees of a path's ASNs meet in one row of their message."""
    paths = updates.filter(F.size("path") >= 3).select("msg_id", "event_us", "path")
    probes = paths.select("msg_id", "event_us", F.explode(F.array_distinct("path")).alias("asn"))
    known = degree_asof(episodes, probes, bucket_us).groupBy("msg_id", "event_us").agg(F.map_from_entries(F.collect_list(F.struct("asn", "degree"))).alias("degrees"))
    triples = path_triples(met(paths, known, ["msg_id", "event_us"]), collapse_prepends, "degrees")
    at = lambda c: F.coalesce(F.try_element_at("degrees", F.col(c)), F.lit(0))
    both = triples.withColumns({"rel_in": _role(at("y"), at("learned_from"), ratio), "rel_out": _role(at("y"), at("told"), ratio)})
    return both.filter(_is_valley("rel_in", "rel_out")).select("msg_id", "event_us", "path", "i", "y", "learned_from", "told")


def suppress_repeats(leaks: DataFrame, window_us: int = LEAK_WINDOW_US, spread_us: int = SPREAD_US) -> DataFrame:
    """Leaks of an AS whose violation before, reported or not, is ``window_us`` or longer ago. An offender's history is
    spread over buckets of ``spread_us``."""
    rows = lagged(leaks, ["offending_asn"], ["event_us", "msg_id"], spread_us, _last=F.col("event_us"))
    return rows.filter(F.col("_last").isNull() | (F.col("event_us") - F.col("_last") >= window_us)).drop("_last")


def vantage_counts(ops: DataFrame, window_us: int = CHURN_WINDOW_US, spread_us: int = SPREAD_US) -> DataFrame:
    """For each announcement with a peer: announcements of that prefix by that peer in the trailing window,
    both ends included, itself and earlier ones only, and ``nth``, those so far. Each announcement adds one at its
    time and takes one away behind the last row of the time at which it leaves the window, so that a count is a running sum,
    whatever the window holds. The history of a vantage is spread over buckets of ``spread_us``."""
    rows = ops.filter("op = 'A' and peer_asn is not null").select("msg_id", "event_us", "pos", "prefix", "family", "net_key", "peer_asn")
    turns = F.array(F.struct(F.col("event_us").alias("_at"), F.lit(1).alias("_change")), F.struct((F.col("event_us") + window_us).alias("_at"), F.lit(-1).alias("_change")))
    dealt = rows.select("*", F.inline(turns)).withColumn("_bucket", F.expr(f"_at div {spread_us}L"))
    key = ["prefix", "peer_asn", "_bucket"]
    arrived = (F.col("_change") > 0).cast("int")
    sums = dealt.groupBy(*key).agg(F.sum("_change").alias("_n"), F.sum(arrived).alias("_nth"))
    earlier = Window.partitionBy("prefix", "peer_asn").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_nth")])
    order = Window.partitionBy(*key).orderBy("_at", F.desc("_change"), "msg_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumns({"_n": F.sum("_change").over(order), "_nth": F.sum(arrived).over(order)}).filter("_change > 0")
    whole = met(running, before, key)
    count = lambda c: (F.col(f"{c}_before") + F.col(c)).cast("int")
    return whole.select("msg_id", "event_us", "pos", "prefix", "family", "net_key", "peer_asn", count("_nth").alias("nth"), count("_n").alias("n_updates"))


def with_global_index(rows: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """Add ``g``, the place of each row in the total order from 0. Rows are numbered within buckets of time
    and the buckets' sizes, a row each, are summed; no task sees more than a bucket."""
    timed = rows.withColumn("_bucket", F.expr(f"event_us div {bucket_us}L"))
    sizes = timed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # Two steps keep the running sum spread: within spans of 4096 buckets, then over the spans.
    spans = sizes.withColumn("_span", F.expr("_bucket div 4096"))
    inside = Window.partitionBy("_span").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    opening = spans.groupBy("_span").agg(F.sum("_n").alias("_m")).select("_span", F.coalesce(F.sum("_m").over(over), F.lit(0)).alias("_far"))
    starts = met(spans.withColumn("_near", F.coalesce(F.sum("_n").over(inside), F.lit(0))), opening, "_span").select("_bucket", (F.col("_near") + F.col("_far")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*SEQUENCE))
    return met(timed.withColumn("_place", place), starts, "_bucket").withColumn("g", F.col("_start") + F.col("_place") - 1).drop("_bucket", "_place", "_start")


def churn_threshold(counts: DataFrame, min_updates: int = MIN_UPDATES, deviations: float = DEVIATIONS, floor: float = FLOOR, baseline: int = BASELINE, min_samples: int = MIN_SAMPLES, bucket_us: int = 60_000_000) -> DataFrame:
    """Add ``threshold`` to the counts of ``min_updates`` and more: median plus ``deviations`` scaled median
    absolute deviations of the last ``baseline`` counts over all vantages, itself included, but ``floor`` at
    least; ``floor`` alone before ``min_samples``.

    Every block of ``baseline`` counts is a row that holds its own counts and, as numbers alone, those of the block
    before, whatever the data; from the numbers the thresholds of a block are worked out at once."""
    columns = [c for c in counts.columns if c != "n_updates"]
    indexed = with_global_index(counts, bucket_us).withColumn("_block", F.expr(f"g div {baseline}L"))
    number = F.struct("g", F.coalesce("n_updates", F.lit(0)).alias("n"))
    lent = indexed.select("g", "n_updates", *columns, "_block", F.explode(F.array("_block", F.col("_block") + 1)).alias("block"))
    mine = F.col("block") == F.col("_block")
    blocks = lent.groupBy("block").agg(
        F.sort_array(F.collect_list(F.when(mine, F.struct("g", "n_updates", *columns)))).alias("own"),
        F.transform(F.sort_array(F.collect_list(F.when(~mine, number))), lambda x: x["n"]).alias("before"),
    )
    judge = F.pandas_udf(_levels(min_updates, deviations, floor, baseline, min_samples), "array<double>")
    levels = judge("before", F.transform("own", lambda x: F.coalesce(x["n_updates"], F.lit(0))))
    rows = blocks.filter(F.size("own") > 0).select("own", levels.alias("levels")).select(F.inline(F.arrays_zip("own", "levels")).alias("_row", "_level"))
    asks = F.col("_row.n_updates") >= min_updates
    return rows.select("_row.*", F.when(asks, F.col("_level")).alias("threshold")).select(*counts.columns, "threshold")


def _levels(min_updates: int, deviations: float, floor: float, baseline: int, min_samples: int):
    """A function of blocks (the counts before, their own): the thresholds of each block's own counts. It is all of its own, as
    tasks get it as it is. The window is one sorted list, which a count enters as the oldest leaves; the counts nearest to its
    median stand next to each other in it, so that the median deviation is found by bisection."""
    scale = deviations * MAD_SCALE

    def level(placed, run):
        """The threshold of a sorted window, and where the half of it begins that is nearest to the median. ``run`` is where
        that was one count before. What stands in the middle is taken twice, so that it is whole."""
        n = len(placed)
        middle, half = placed[(n - 1) // 2] + placed[n // 2], (n + 1) // 2
        over = placed[run] + placed[run + half] >= middle if run < n - half else True
        if not over or (run and placed[run - 1] + placed[run - 1 + half] >= middle):
            low, high = (0, min(run, n - half)) if over else (run + 1, n - half)
            run = bisect_left(range(n), middle, low, high, key=lambda k: placed[k] + placed[k + half])
        off = max(middle - 2 * placed[run], 2 * placed[run + half - 1] - middle)
        beyond = off
        if n % 2 == 0:
            beyond = 2 * placed[run + half] - middle if run + half < n else None
            if run and (beyond is None or middle - 2 * placed[run - 1] < beyond):
                beyond = middle - 2 * placed[run - 1]
        return max(middle / 2.0 + scale * ((off + beyond) / 4.0), floor), run

    def of_block(before, own):
        out = np.full(len(own), float(floor))
        if not (own >= min_updates).any():
            return out
        every, first = [*before.tolist(), *own.tolist()], len(before)
        placed, run = sorted(every[max(first - baseline, 0) : first]), 0
        for k, n in enumerate(every[first:]):
            if first + k >= baseline:
                del placed[bisect_left(placed, every[first + k - baseline])]
            insort(placed, n)
            if n >= min_updates and len(placed) >= min_samples:
                out[k], run = level(placed, run)
        return out

    def of_blocks(before: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([of_block(np.asarray(x, np.int64), np.asarray(y, np.int64)) for x, y in zip(before, own, strict=True)], dtype=object)

    return of_blocks


def above_threshold(min_updates: int = MIN_UPDATES) -> Column:
    return (F.col("n_updates") >= min_updates) & F.coalesce(F.col("n_updates") > F.col("threshold"), F.lit(False))


def detect_churn(counts: DataFrame, min_updates: int = MIN_UPDATES, running: DataFrame | None = None, spread_us: int = SPREAD_US) -> DataFrame:
    """Counts with ``threshold`` that rise above it: an episode begins where the vantage's count before was not above.
    ``running`` names the vantages (prefix, peer_asn) whose last count before all of these was above. The history of
    a vantage is spread over buckets of ``spread_us``."""
    rows = lagged(counts.withColumn("_above", above_threshold(min_updates)), ["prefix", "peer_asn"], list(SEQUENCE), spread_us, _before=F.col("_above"))
    if running is not None:
        known = running.select("prefix", "peer_asn", F.lit(True).alias("_running"))
        rows = rows.join(known, ["prefix", "peer_asn"], "left").withColumn("_before", F.coalesce("_before", "_running")).drop("_running")
    fired = rows.filter(F.col("_above") & ~F.coalesce("_before", F.lit(False))).drop("_above", "_before")
    return fired.withColumn("severity", _severity(F.col("n_updates") / F.col("threshold") >= 2))


def anomalies(hijacks: DataFrame | None = None, leaks: DataFrame | None = None, churn: DataFrame | None = None) -> DataFrame:
    """All kinds in one table; columns that do not apply are null. ``stage`` and ``pos`` order the anomalies of
    one message as the detectors run: the leak, then for each prefix hijack and churn."""
    parts = []
    if hijacks is not None:
        parts.append(hijacks.select("msg_id", "event_us", F.lit(2).alias("stage"), "pos", F.lit("prefix_hijack").alias("kind"), "severity", "prefix", "family", "net_key", "previous_origin", "new_origin"))
    if leaks is not None:
        parts.append(leaks.select("msg_id", "event_us", F.lit(1).alias("stage"), F.lit(0).alias("pos"), F.lit("path_leak").alias("kind"), "severity", "offending_asn", F.col("path").alias("as_path")))
    if churn is not None:
        parts.append(churn.select("msg_id", "event_us", F.lit(3).alias("stage"), "pos", F.lit("route_churn").alias("kind"), "severity", "prefix", "family", "net_key", F.col("n_updates").alias("updates_in_window"), "threshold"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    kinds = {"prefix": "string", "family": "tinyint", "net_key": "string", "previous_origin": "bigint", "new_origin": "bigint", "offending_asn": "bigint", "as_path": "array<bigint>", "updates_in_window": "int", "threshold": "double"}
    return out.select("msg_id", "event_us", "stage", "pos", "kind", "severity", *[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
