"""Streams of anomalies, edges and change frames.

Each keyed detector keeps the small state that its rule needs in the RocksDB state store (``use_state_store``), reads and writes
the parts of it that a batch touches, and drops it by a timer in event time once the watermark shows that it decides nothing
more. A key's rows of a batch are worked out as arrays, in order. Rows that come in a later batch than rows of a later
time count as of their own time but after those; ``late_batches`` sets them aside and ``repair`` brings the tables
to what a batch run over the archive gives. Input rows are what ``operators`` make of a stream of updates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Event, Thread

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.operators import detect, feed, geo, history, routes, topology
from asnwatch.operators.origins import MOST_ORIGINS
from asnwatch.operators.spread import drop_versions
from asnwatch.sources.relationships import with_both_directions

_SEQ = ["event_us", "msg_id", "pos"]
#: Seconds that ``counted_batches`` waits for what was observed after its sink has ended.
OBSERVED_S = 10
#: Keys of a stream over which edges or messages, of which there are many with little work each, are dealt out.
SHARDS = 128


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams that are started from now on in RocksDB, as the detectors need, and write what a batch changes
    in it as a log; a stream that goes on from its checkpoint keeps its own store."""
    store = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{store}.rocksdb.changelogCheckpointing.enabled", "true")


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key in this batch; a key's share of one micro-batch fits a task."""
    parts = list(frames)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _keyed(rows: DataFrame, key: list[str], processor: StatefulProcessor, out: str, timed: bool = True, time_column: str = "") -> DataFrame:
    return rows.groupBy(*key).transformWithStateInPandas(processor, out, "append", "eventtime" if timed else "none", eventTimeColumnName=time_column)


def _shard(shards: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard")


class _Origins(StatefulProcessor):
    """Of a network: the last origin and how many are remembered (a value), and those origins (a map, looked up one by one)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "origin long, remembered int")
        self.known = handle.getMapState("known", "origin long", "place int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = _in_order(rows, _SEQ)
        every["segment"] = (every["op"] == "W").cumsum()
        said = every[(every["op"] == "A") & every["origin_asn"].notna()].copy()
        last, remembered = self.latest.get() or (None, 0)
        segment, origin = said["segment"], said["origin_asn"].astype("int64")
        first = ~pd.DataFrame({"segment": segment, "origin": origin}).duplicated()
        if last is not None:
            old = {x for x in origin[segment == 0].unique().tolist() if self.known.containsKey((x,))}
            first &= ~((segment == 0) & origin.isin(old))
        place = first.astype(int).groupby(segment).cumsum() + np.where(segment == 0, remembered, 0)
        own = place.where(first).groupby([segment, origin]).transform("max").fillna(0)  # 0: remembered before
        before = origin.astype("Int64").groupby(segment).shift()
        if last is not None and len(said) and segment.iloc[0] == 0:
            before.iloc[0] = last
        said = said.assign(previous_origin=before, new_origin=origin, distinct_origins=np.minimum(place, MOST_ORIGINS), family=key[0], net_key=key[1])
        said["severity"] = np.where(said["distinct_origins"] >= 3, detect.HIGH, detect.MEDIUM)
        fired = said[before.notna() & (first | (own > MOST_ORIGINS))]

        end = every["segment"].iloc[-1]
        if end and last is not None:
            self.latest.clear()
            self.known.clear()
        mine = segment == end
        if mine.any():
            for x, n in zip(origin[mine & first].tolist(), place[mine & first].tolist(), strict=True):
                if n <= MOST_ORIGINS:
                    self.known.updateValue((x,), (n,))
            self.latest.update((int(origin[mine].iloc[-1]), int(min(place[mine].iloc[-1], MOST_ORIGINS))))
        yield fired[["msg_id", "event_us", "pos", "prefix", "family", "net_key", "previous_origin", "new_origin", "distinct_origins", "severity"]]

    def close(self) -> None:
        pass


def stream_hijacks(ops: DataFrame) -> DataFrame:
    """Origin changes by network, as ``detect.detect_hijacks``. What a network's origins are stays until a withdrawal."""
    out = "msg_id long, event_us long, pos int, prefix string, family byte, net_key string, previous_origin long, new_origin long, distinct_origins int, severity short"
    return _keyed(ops.select("family", "net_key", *_SEQ, "op", "prefix", "origin_asn"), ["family", "net_key"], _Origins(), out, timed=False)


class _Valleys(StatefulProcessor):
    """The apexes of a shard's messages; those of a message come in one batch: no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = _in_order(rows, ["msg_id", "i"])
        nearest = found[~found["msg_id"].duplicated(keep="last")]
        violations = found.groupby("msg_id", sort=True)["i"].size().to_numpy()
        severity = np.where(violations > 1, detect.HIGH, detect.MEDIUM)
        yield nearest[["msg_id", "event_us", "event_ts"]].assign(offending_asn=nearest["y"], violations=violations, severity=severity)

    def close(self) -> None:
        pass


class _Offenders(StatefulProcessor):
    """Of an offender: when its last violation was, until it is so long ago that the next one is reported in any case."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_us long")

    def _until(self, last: int, timer_values) -> None:
        self.handle.registerTimer(max((last + self.window_us) // 1000 + 1, timer_values.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = _in_order(rows, ["event_us", "msg_id"])
        last = self.last.get()
        times = found["event_us"].to_numpy()
        gaps = np.diff(times, prepend=last[0] if last else times[0] - self.window_us)
        self.last.update((int(times[-1]),))
        if not last:  # one timer a key: it is set on when it comes too early
            self._until(int(times[-1]), timerValues)
        yield found[gaps >= self.window_us][["msg_id", "event_us", "event_ts", "offending_asn", "violations", "severity"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        if (last + self.window_us) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        else:
            self._until(last, timerValues)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def leak_stream(updates: DataFrame, relationships: DataFrame) -> DataFrame:
    """A row for each message with a valley, by a stream-static join. A message's rows come in one batch, so it is
    complete when it is met."""
    sides = with_both_directions(relationships)
    inner = sides.select(F.col("a").alias("y"), F.col("b").alias("learned_from"), F.col("rel").alias("rel_in"))
    outer = sides.select(F.col("a").alias("y"), F.col("b").alias("told"), F.col("rel").alias("rel_out"))
    apexes = detect.path_triples(updates, False, "event_ts").join(inner, ["y", "learned_from"]).join(outer, ["y", "told"])
    apexes = apexes.filter(F.col("rel_in").isin("customer", "peer") & F.col("rel_out").isin("customer", "peer"))
    out = "msg_id long, event_us long, event_ts timestamp, offending_asn long, violations int, severity short"
    return _keyed(apexes.select(_shard(SHARDS, "msg_id"), "msg_id", "event_us", "event_ts", "i", "y"), ["shard"], _Valleys(), out, time_column="event_ts")


def stream_leaks(updates: DataFrame, relationships: DataFrame, window_us: int = detect.LEAK_WINDOW_US) -> DataFrame:
    """Leaks without repeats, as ``detect.suppress_repeats`` of ``detect.path_leaks``: two keyed steps of one query, by message
    and then by offender; the time of a leak carries the watermark from one to the other."""
    out = "msg_id long, event_us long, event_ts timestamp, offending_asn long, violations int, severity short"
    return _keyed(leak_stream(updates, relationships), ["offending_asn"], _Offenders(window_us), out, time_column="event_ts")


class _Vantage(StatefulProcessor):
    """Of a prefix and peer: the times within the window before the last row (a list that is added to; it is written anew when
    a time falls out of it), until a count after them is 1 in any case."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "event_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = _in_order(rows, _SEQ)
        now = found["event_us"].to_numpy()
        old = np.sort(np.fromiter((x[0] for x in self.times.get()), np.int64))
        since = now - self.window_us
        counts = len(old) - np.searchsorted(old, since) + np.arange(1, len(now) + 1) - np.searchsorted(now, since)
        every = np.append(old, now)
        kept = every >= now[-1] - self.window_us
        if kept[: len(old)].all():
            self.times.appendList([(x,) for x in every[kept][len(old) :].tolist()])
        else:
            self.times.put([(x,) for x in every[kept].tolist()])
        if not len(old):
            self._until(int(every.max()), timerValues)
        yield pd.DataFrame({"msg_id": found["msg_id"], "event_us": now, "pos": found["pos"], "prefix": key[0], "peer_asn": key[1], "n_updates": counts})

    def _until(self, last: int, timer_values) -> None:
        self.handle.registerTimer(max((last + self.window_us) // 1000 + 2, timer_values.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max(x[0] for x in self.times.get())
        if (last + self.window_us) // 1000 + 1 < timerValues.getCurrentWatermarkInMs():
            self.times.clear()
        else:
            self._until(last, timerValues)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_churn_counts(ops: DataFrame, window_us: int = detect.CHURN_WINDOW_US) -> DataFrame:
    """Announcements in the trailing window by prefix and peer. Rows later than the watermark are dropped; ``late_batches``
    keeps them before they come here."""
    rows = ops.filter("op = 'A' and peer_asn is not null").select("prefix", "peer_asn", *_SEQ, "event_ts")
    out = "msg_id long, event_us long, pos int, prefix string, peer_asn long, n_updates int"
    return _keyed(rows, ["prefix", "peer_asn"], _Vantage(window_us), out)


def churn_batches(sink: Callable[[DataFrame, int], None], ring_path: str, keep_judged: Callable[[DataFrame, int], None] | None = None, **parameters) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``stream_churn_counts``: thresholds from the counts of this batch and the
    last ones before it, kept as a small table under ``ring_path``. Beside it, in ``running``, are the vantages
    whose last count was above its threshold, so that an episode that goes on is not reported again. Each batch
    writes new versions named by its number, so a replayed batch starts from the same state. ``keep_judged`` gets all
    counts of a batch with their thresholds, what ``repair.repair_churn`` starts from."""
    keep, least = parameters.get("baseline", detect.BASELINE), parameters.get("min_updates", detect.MIN_UPDATES)
    vantage = ["prefix", "peer_asn"]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts, running = batch.withColumn("fresh", F.lit(True)), None
        if number:
            old = spark.read.schema("msg_id long, event_us long, pos int, prefix string, peer_asn long, n_updates int").parquet(f"{ring_path}/{number - 1}")
            counts = counts.unionByName(old.withColumn("fresh", F.lit(False)))
            running = spark.read.schema("prefix string, peer_asn long").parquet(f"{ring_path}/running/{number - 1}")
        counts = counts.persist()
        judged = detect.churn_threshold(counts, **parameters).filter("fresh").drop("fresh").persist()
        if keep_judged:
            keep_judged(judged, number)
        sink(detect.detect_churn(judged, least, running), number)
        last = judged.withColumn("above", detect.above_threshold(least)).groupBy(*vantage).agg(F.max_by("above", F.struct(*_SEQ)).alias("above"))
        above = last.filter("above").select(*vantage)
        if running is not None:
            above = above.union(running.join(last, vantage, "left_anti"))
        above.write.mode("overwrite").parquet(f"{ring_path}/running/{number}")
        counts.drop("fresh").orderBy(F.desc("event_us"), F.desc("msg_id"), F.desc("pos")).limit(keep).write.mode("overwrite").parquet(f"{ring_path}/{number}")
        drop_versions(spark, ring_path, number)
        drop_versions(spark, f"{ring_path}/running", number)
        judged.unpersist()
        counts.unpersist()

    return run


class _Links(StatefulProcessor):
    """Of the edges of a shard that are up: (lo, hi, when it was last seen), as bytes, read and written once a batch. An edge
    goes down at its sweep, when the watermark has passed that or it is seen again later."""

    def __init__(self, ttl_us: int, sweep_us: int):
        self.ttl_us, self.sweep_us = ttl_us, sweep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.links = handle.getValueState("links", "links binary, due_ms long")

    def _down_at(self, us):
        return ((us + self.ttl_us) // self.sweep_us + 1) * self.sweep_us

    def _known(self) -> tuple[np.ndarray, int | None]:
        """(rows of lo, hi and last; the timer that is set)."""
        kept = self.links.get()
        return (np.frombuffer(bytes(kept[0]), np.int64).reshape(-1, 3), kept[1]) if kept else (np.empty((0, 3), np.int64), None)

    def _keep(self, links: np.ndarray, due: int | None, timer_values) -> None:
        """One timer a shard, for the first of its edges to go down; one that comes too early is set on."""
        if not len(links):
            self.links.clear()
            return
        first = max(int(self._down_at(links[:, 2]).min()) // 1000 + 1, timer_values.getCurrentWatermarkInMs() + 1)
        if due is None or first < due:
            self.handle.registerTimer(first)
            due = first
        self.links.update((links.tobytes(), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows))
        old, due = self._known()
        column = lambda k, c: np.concatenate([old[:, k] if k is not None else np.zeros(len(old), np.int64), fresh[c].to_numpy(np.int64)])
        every = {c: column(k, c) for c, k in (("lo", 0), ("hi", 1), ("event_us", 2), ("msg_id", None), ("hop", None), ("a", None), ("b", None))}
        every["is_new"] = np.arange(len(old) + len(fresh)) >= len(old)
        order = np.lexsort([every[c] for c in ("hop", "msg_id", "event_us", "is_new", "hi", "lo")])  # what is known of an edge, then its rows
        every = {c: x[order] for c, x in every.items()}
        lo, hi, times = every["lo"], every["hi"], every["event_us"]
        starts = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        heads = np.flatnonzero(starts)
        opening = times[heads[np.cumsum(starts) - 1]]
        down = self._down_at(np.maximum(opening, np.append(times[0], times[:-1])))
        again = ~starts & (times > down)
        up = again | (starts & every["is_new"])
        ends = np.append(heads[1:], len(times)) - 1
        self._keep(np.stack([lo[heads], hi[heads], np.maximum(times[heads], times[ends])], axis=1), due, timerValues)
        yield self._down(lo[again], hi[again], down[again])
        yield pd.DataFrame({"kind": feed.LINK_UP, "a": every["a"][up], "b": every["b"][up], "event_us": times[up], "msg_id": every["msg_id"][up], "stage": 0, "pos": every["hop"][up]})

    def _down(self, lo, hi, times) -> pd.DataFrame:
        return pd.DataFrame({"kind": feed.LINK_DOWN, "a": lo, "b": hi, "event_us": times, "msg_id": feed.SWEEP, "stage": 9, "pos": 0})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        links, _ = self._known()
        down = self._down_at(links[:, 2])
        gone = down // 1000 < timerValues.getCurrentWatermarkInMs()
        self._keep(links[~gone], None, timerValues)
        yield self._down(links[gone, 0], links[gone, 1], down[gone])

    def close(self) -> None:
        pass


def stream_edges(observations: DataFrame, ttl_us: int = topology.TTL_US, sweep_us: int = topology.SWEEP_US, shards: int = SHARDS) -> DataFrame:
    """Links coming up and going down, with their order among all frames: (kind, a, b, event_us, msg_id, stage, pos). Edges are
    dealt out to ``shards``, each of which is one key of the stream: a call for each edge would cost more than its work."""
    rows = observations.select(_shard(shards, "lo", "hi"), "lo", "hi", "a", "b", "event_us", "msg_id", "hop", "event_ts")
    return _keyed(rows, ["shard"], _Links(ttl_us, sweep_us), "kind string, a long, b long, event_us long, msg_id long, stage int, pos int")


def history_batches(path: str, prune_every: int = 0, retention_days: int = history.RETENTION_DAYS, max_bytes: int = history.MAX_BYTES) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over anomalies: write them by day into a folder a batch, so that a replay overwrites
    itself, and drop old days every ``prune_every`` batches."""

    def run(batch: DataFrame, number: int) -> None:
        rows = history.to_history(batch)
        rows.withColumn("batch", F.lit(number)).repartition("day").write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        if prune_every and number % prune_every == prune_every - 1:
            spark = batch.sparkSession
            manifest = history.day_manifest(history.read_history(spark, path)).persist()
            old = history.prune_by_age(manifest, F.current_timestamp(), retention_days)
            large = history.prune_by_size(manifest.join(old, "day", "left_anti"), max_bytes)
            history.drop_days(spark, path, old.union(large))
            manifest.unpersist()

    return run


def feed_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over change frames: the sink that subscribers follow, JSON lines in a folder a batch, in the
    order of the frames. A replayed batch overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        order = [c for c in feed.ORDER if c in batch.columns]
        frames = feed.delta_frames(batch).repartitionByRange(*order).sortWithinPartitions(*order)
        frames.select("value").write.mode("overwrite").text(f"{path}/batch={number:09d}")

    return run


def subscription(spark: SparkSession, path: str, edges: DataFrame, after_batch: int = -1, most: int | None = 2000) -> DataFrame:
    """What a new subscriber reads of a feed's sink: (batch, value), frames of up to ``most`` current links (None: all) as batch
    ``after_batch`` and then the frames of all later batches. Frames may repeat; folding them changes nothing."""
    first = feed.delta_frames(feed.snapshot_frames(edges, most)).select(F.lit(after_batch).alias("batch"), "value")
    later = spark.read.schema("value string, batch int").text(path).filter(F.col("batch") > after_batch)
    return first.union(later.select("batch", "value"))


def late_batches(sink: Callable[[DataFrame, int], None], path: str, delay_us: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over updates: rows more than ``delay_us`` older than the newest row of all batches before go to
    the table ``late`` under ``path``, the others to ``sink``. The newest time is kept in a version a batch, so a
    replayed batch is divided alike."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("newest_us long").parquet(f"{path}/newest/{number - 1}").first() if number else None
        newest = before["newest_us"] if before else None
        batch = batch.persist()
        late = F.lit(False) if newest is None else F.col("event_us") < newest - delay_us
        batch.filter(late).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/late/{number}")
        sink(batch.filter(~late), number)
        batch.agg(F.greatest(F.max("event_us"), F.lit(newest).cast("long")).alias("newest_us")).write.mode("overwrite").parquet(f"{path}/newest/{number}")
        drop_versions(spark, f"{path}/newest", number)
        batch.unpersist()

    return run


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of late rows that ``late_batches`` keeps."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/late")


def counted_batches(sink: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: live counters. Rows and their first and last time are observed while ``sink`` reads the batch, with
    no job of their own, and written as a row a batch under ``path``. A sink that reads nothing costs a job that counts."""

    def run(batch: DataFrame, number: int) -> None:
        done = Event()
        counts = (F.count("*").alias("messages"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"))
        seen = Observation(f"batch {number}")
        observed = batch.observe(seen, *counts)
        sink(observed, number)
        waiter = Thread(target=lambda: (seen.get, done.set()), daemon=True)
        waiter.start()
        row = seen.get if done.wait(OBSERVED_S) else batch.agg(*counts).first().asDict()
        values = [(number, *(row[c] for c in ("messages", "first_us", "last_us")))]
        batch.sparkSession.createDataFrame(values, "batch long, messages long, first_us long, last_us long").write.mode("overwrite").parquet(f"{path}/{number}")

    return run


def whole_feed(updates: DataFrame, ttl_us: int = topology.TTL_US, sweep_us: int = topology.SWEEP_US, window_us: int = detect.CHURN_WINDOW_US) -> DataFrame:
    """All that the change feed is made of, as one stream from three keyed detectors: rows of ``part`` link (frames), hijack
    and count (of announcements, for the churn baseline), for ``whole_feed_batches``."""
    ops = routes.route_ops(updates)
    links = stream_edges(topology.canonical_edge(topology.path_pairs(updates, "event_ts")), ttl_us, sweep_us).withColumn("part", F.lit("link"))
    hijacks = stream_hijacks(ops).withColumn("part", F.lit("hijack"))
    counts = stream_churn_counts(ops, window_us).withColumn("part", F.lit("count"))
    return links.unionByName(hijacks, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)


_LIVE = "lo long, hi long, a long, b long, event_us long, msg_id long, stage int, pos int, kind string"


def whole_feed_batches(path: str, regions: DataFrame, versions: int = 3, **churn) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``whole_feed``. Under ``path``, frames/batch=N holds the frames of a batch in one order, links and
    areas of hijacks and churn that ``regions`` places, with their JSON as ``value``; live/N is the table of links that are up
    after batch N, made of the one before and the batch's frames. The last ``versions`` of it are kept. A
    replayed batch overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        links = batch.filter("part = 'link'").select("kind", "a", "b", *feed.ORDER)
        hijacks = batch.filter("part = 'hijack'")

        def write(fired: DataFrame, number: int) -> None:
            found = detect.anomalies(hijacks, None, normalise_prefixes(fired))
            frames = feed.as_frames(links).union(feed.as_frames(geo.area_degraded(found, regions).withColumns({"kind": F.lit(feed.AREA), "severity": F.col("severity_index")})))
            feed.delta_frames(frames).repartitionByRange(*feed.ORDER).sortWithinPartitions(*feed.ORDER).write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

        counts = batch.filter("part = 'count'").select(*_SEQ, "prefix", "peer_asn", "n_updates")
        churn_batches(write, f"{path}/ring", **churn)(counts, number)
        fresh = topology.canonical_edge(links)
        if number:
            fresh = spark.read.schema(_LIVE).parquet(f"{path}/live/{number - 1}").unionByName(fresh)
        rest = [c for c in fresh.columns if c not in ("lo", "hi")]
        last = fresh.groupBy("lo", "hi").agg(F.max_by(F.struct(*rest), F.struct(*feed.ORDER)).alias("last"))
        last.select("lo", "hi", "last.*").filter(F.col("kind") == feed.LINK_UP).write.mode("overwrite").parquet(f"{path}/live/{number}")
        drop_versions(spark, f"{path}/live", number, versions)
        batch.unpersist()

    return run


def feed_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frames that ``whole_feed_batches`` has written, with their batch."""
    return spark.read.schema("event_us long, msg_id long, stage int, pos int, kind string, a long, b long, region string, severity float, value string, batch int").parquet(f"{path}/frames")


def subscription_at(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """What a subscriber reads who begins after ``batch``, with the order to read it in: the links that were up then, as frames,
    and the frames of later batches, which follow without gap or overlap."""
    live = spark.read.schema(_LIVE).parquet(f"{path}/live/{batch}").withColumns({"a": F.col("lo"), "b": F.col("hi"), "batch": F.lit(batch)})
    snapshot = feed.delta_frames(live.withColumns({"region": F.lit(None).cast("string"), "severity": F.lit(None).cast("float")}))
    columns = ["batch", *feed.ORDER, "value"]
    return snapshot.select(columns).union(feed_frames(spark, path).filter(F.col("batch") > batch).select(columns))
