"""Registered streaming queries: a stream over ``events``, run until its files are used up, and its sink read.

The events arrive in SLICES parts, as a rule in order of time, a micro-batch each. On the way the stream is started again
from its checkpoint, so that every query runs over several micro-batches and a restart at least."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from asnwatch.operators import feed, monitor, routes, topology
from asnwatch.operators.spread import stored
from asnwatch.plans import tables as t
from asnwatch.plans.queries import CHURN, LEAK_WINDOW, SWEEP, TTL, query
from asnwatch.plans.queries import _anomalies as batch_anomalies
from asnwatch.plans.queries import _live as batch_live
from asnwatch.plans.queries import _relationships as batch_relationships
from asnwatch.plans.sql import D
from asnwatch.schemas import UPDATES
from asnwatch.streaming import repair, streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SLICES = 5
FILES = 4
LATE = 5 * D


def _by_time(spark: SparkSession, d: str) -> list[DataFrame]:
    events = t.table(spark, d, "events").withColumn("_us", t.micros())
    shares = [F.percentile_approx("_us", k / SLICES) for k in range(1, SLICES)]
    cuts = [-(1 << 62), *(x for x in events.agg(F.array(*shares)).first()[0] or []), 1 << 62]
    return [events.filter((F.col("_us") > a) & (F.col("_us") <= b)).drop("_us") for a, b in zip(cuts, cuts[1:], strict=False)]


def _shuffled(spark: SparkSession, d: str) -> list[DataFrame]:
    events = t.table(spark, d, "events")
    return [events.filter(F.col("event_id") % SLICES == k) for k in range(SLICES)]


def _run(spark: SparkSession, d: str, *start: Callable[[str], StreamingQuery], slices: Callable = _by_time, starts: int = 2) -> str:
    """Write the slices, FILES files each, and run the streams that ``start`` begins over them, one after the other, ``starts``
    times on the way; the folder of all that. A micro-batch takes as many files as a slice has."""
    path = t.scratch(spark, "stream")
    streams.use_state_store(spark)
    with _state_partitions(spark):
        for k, part in enumerate(slices(spark, d), 1):
            part.repartition(FILES).write.mode("append").parquet(f"{path}/events")
            if k * starts // SLICES > (k - 1) * starts // SLICES:
                for each in start:
                    each(path).awaitTermination()
    return path


@contextmanager
def _state_partitions(spark: SparkSession) -> Iterator[None]:
    """No more state partitions than the cluster has cores: each costs a commit a batch, and a stream keeps their number."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), max(spark.sparkContext.defaultParallelism, 2)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _updates(spark: SparkSession, path: str) -> DataFrame:
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", FILES).parquet(f"{path}/events")
    return t.message_rows(events).withWatermark("event_ts", "0 seconds")


def _to_files(stream: DataFrame, path: str) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    return writer.trigger(availableNow=True).start()


def _to_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], path: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


@query("SELECT msg_id, prefix, previous_origin, origin_asn AS new_origin, distinct_origins, severity FROM hijacks")
def stream_hijacks(spark: SparkSession, d: str) -> DataFrame:
    found = lambda path: streams.stream_hijacks(routes.route_ops(_updates(spark, path)))
    path = _run(spark, d, lambda path: _to_files(found(path), path))
    return spark.read.schema(found(path).schema).parquet(f"{path}/out").select("msg_id", "prefix", "previous_origin", "new_origin", "distinct_origins", "severity")


@query("SELECT msg_id, event_us, offending_asn, violations, severity FROM reported")
def stream_leaks(spark: SparkSession, d: str) -> DataFrame:
    relationships = stored(batch_relationships(spark, d))
    found = lambda path: streams.stream_leaks(_updates(spark, path), relationships, LEAK_WINDOW)
    path = _run(spark, d, lambda path: _to_files(found(path), path))
    return spark.read.schema(found(path).schema).parquet(f"{path}/out").select("msg_id", "event_us", "offending_asn", "violations", "severity")


_CHURN_SQL = "SELECT msg_id, prefix, peer_asn, n_updates, round(threshold, 6) AS threshold, severity FROM churn"
_FIRED = "msg_id long, event_us long, pos int, prefix string, peer_asn long, n_updates int, threshold double, severity short"


@query(_CHURN_SQL)
def stream_churn(spark: SparkSession, d: str) -> DataFrame:
    def start(path: str) -> StreamingQuery:
        sink = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        counts = streams.stream_churn_counts(routes.route_ops(_updates(spark, path)), 3 * D)
        return _to_batches(counts, streams.churn_batches(sink, f"{path}/ring", **CHURN), path)

    path = _run(spark, d, start)
    out = spark.read.schema(_FIRED).parquet(f"{path}/out")
    return out.select("msg_id", "prefix", "peer_asn", "n_updates", F.round("threshold", 6).alias("threshold"), "severity")


def _link_changes(spark: SparkSession, path: str) -> DataFrame:
    observed = topology.canonical_edge(topology.path_pairs(_updates(spark, path), "event_ts"))
    return streams.stream_edges(observed, TTL, SWEEP)


_EDGES_SQL = "SELECT 'LinkUp' AS kind, a, b, up_us AS event_us FROM episodes UNION ALL SELECT 'LinkDown', lo, hi, down_us FROM episodes WHERE down_us IS NOT NULL"


@query(_EDGES_SQL)
def stream_edges(spark: SparkSession, d: str) -> DataFrame:
    path = _run(spark, d, lambda path: _to_files(_link_changes(spark, path), path))
    return spark.read.schema(_link_changes(spark, path).schema).parquet(f"{path}/out").select("kind", "a", "b", "event_us")


@query("""SELECT 'live' AS part, '{"kind":"LinkUp","a":' || a || ',"b":' || b || '}' AS value FROM episodes
    UNION ALL SELECT 'live', '{"kind":"LinkDown","a":' || lo || ',"b":' || hi || '}' FROM episodes WHERE down_us IS NOT NULL
    UNION ALL SELECT 'snapshot', '{"kind":"LinkUp","a":' || lo || ',"b":' || hi || '}' FROM live""")
def stream_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Link frames written to the feed's sink batch by batch, and what a subscriber reads who begins with a snapshot."""

    def start(path: str) -> StreamingQuery:
        frames = _link_changes(spark, path).withColumns({"region": F.lit(None).cast("string"), "severity": F.lit(None).cast("float")})
        return _to_batches(frames, streams.feed_batches(f"{path}/feed"), path)

    path = _run(spark, d, start)
    edges = batch_live(spark, d)
    rows = streams.subscription(spark, f"{path}/feed", edges, most=None)
    return rows.select(F.when(F.col("batch") < 0, "snapshot").otherwise("live").alias("part"), "value")


@query(f"""SELECT m.msg_id, m.event_us FROM msg m JOIN (SELECT k, max(newest) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_us
    FROM (SELECT msg_id % {SLICES} AS k, max(event_us) AS newest FROM msg GROUP BY 1)) b ON b.k = m.msg_id % {SLICES} WHERE m.event_us < b.before_us - {LATE}""")
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Messages that arrive out of order, and of them those more than LATE behind."""

    def start(path: str) -> StreamingQuery:
        sink = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/on_time/{number}")
        return _to_batches(_updates(spark, path).select("msg_id", "event_us"), streams.late_batches(sink, f"{path}/policy", LATE), path)

    path = _run(spark, d, start, slices=_shuffled, starts=SLICES)
    return streams.late_rows(spark, f"{path}/policy", "msg_id long, event_us long")


# Late rows beside detectors: one in twenty comes a slice after its time.


def _some_late(spark: SparkSession, d: str) -> list[DataFrame]:
    events = t.table(spark, d, "events").withColumn("_us", t.micros())
    low, high = events.agg(F.min("_us"), F.max("_us")).first()
    arrival = F.expr(f"(_us - {low or 0}L) div {((high or 0) - (low or 0)) // SLICES + 1}L")
    late = (F.col("event_id") % 20 == 7) & (arrival < SLICES - 1)
    events = events.withColumn("_k", arrival + late.cast("int"))
    return [events.filter(F.col("_k") == k).drop("_us", "_k") for k in range(SLICES)]


def _on_time(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", FILES).parquet(f"{path}/on_time").drop("batch").withWatermark("event_ts", "0 seconds")


def _set_aside(spark: SparkSession, path: str) -> StreamingQuery:
    """Rows older than any of a batch before go to the table of late rows, the others to ``on_time``."""
    sink = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
    return _to_batches(_updates(spark, path), streams.late_batches(sink, f"{path}/policy", 0), f"{path}/aside")


def _archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all updates, late ones)."""
    late = streams.late_rows(spark, f"{path}/policy", UPDATES)
    return spark.read.schema(UPDATES).option("recursiveFileLookup", "true").parquet(f"{path}/on_time").union(late), late


@query(_EDGES_SQL)
def stream_late_edges(spark: SparkSession, d: str) -> DataFrame:
    """Link changes of a stream from which late rows were kept, repaired by those."""
    changes = lambda path: streams.stream_edges(topology.canonical_edge(topology.path_pairs(_on_time(spark, path), "event_ts")), TTL, SWEEP)
    path = _run(spark, d, lambda path: _set_aside(spark, path), slices=_some_late, starts=SLICES)
    with _state_partitions(spark):
        _to_files(changes(path), path).awaitTermination()
    every, late = _archive(spark, path)
    as_of = every.agg(F.max("event_us")).first()[0] or 0
    written = spark.read.schema(changes(path).schema).parquet(f"{path}/out")
    return repair.repair_edges(written, topology.path_edges(every), topology.path_edges(late), as_of, TTL, SWEEP, D)


@query(_CHURN_SQL)
def stream_late_churn(spark: SparkSession, d: str) -> DataFrame:
    """Churn of a stream from which late rows were kept, repaired by those."""

    def start(path: str) -> StreamingQuery:
        to = lambda table: lambda df, number: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
        counts = streams.stream_churn_counts(routes.route_ops(_on_time(spark, path)), 3 * D)
        return _to_batches(counts, streams.churn_batches(to("out"), f"{path}/ring", to("judged"), **CHURN), path)

    path = _run(spark, d, lambda path: _set_aside(spark, path), slices=_some_late, starts=SLICES)
    with _state_partitions(spark):
        start(path).awaitTermination()
    every, late = (stored(routes.route_ops(x)) for x in _archive(spark, path))
    judged = spark.read.schema(_FIRED.replace(", severity short", "")).parquet(f"{path}/judged").drop("batch")
    out = repair.repair_churn(judged, spark.read.schema(_FIRED).parquet(f"{path}/out").drop("batch"), every, late, 3 * D, D, **CHURN)
    return out.select("msg_id", "prefix", "peer_asn", "n_updates", F.round("threshold", 6).alias("threshold"), "severity")


_ARRIVING = f"""SELECT m.event_us, k + CASE WHEN msg_id % 20 = 7 AND k < {SLICES - 1} THEN 1 ELSE 0 END AS arrival FROM (SELECT msg.*, (event_us - low) // width AS k
    FROM msg, (SELECT min(event_us) AS low, (max(event_us) - min(event_us)) // {SLICES} + 1 AS width FROM ev)) m"""


@query(f"""SELECT date_trunc('day', make_timestamp(a.event_us)) AS bucket_start, CASE WHEN coalesce(a.event_us < b.newest_us, false) THEN 'late' ELSE 'messages' END AS counter, count(*) AS n FROM ({_ARRIVING}) a
    JOIN (SELECT arrival, max(max(event_us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_us FROM ({_ARRIVING}) GROUP BY arrival) b USING (arrival) GROUP BY 1, 2""")
def stream_late_counters(spark: SparkSession, d: str) -> DataFrame:
    """Messages on time and late ones by day."""
    path = _run(spark, d, lambda path: _set_aside(spark, path), slices=_some_late, starts=SLICES)
    every, late = _archive(spark, path)
    on_time = every.join(late.select("msg_id"), "msg_id", "left_anti")
    return monitor.pipeline_counters(on_time, late=late)


@query("""SELECT 'links' AS part, lo || '-' || hi AS name, CAST(up_us AS VARCHAR) AS value FROM live UNION ALL SELECT 'subscriber', lo || '-' || hi, '' FROM live
    UNION ALL SELECT 'regions', region, CAST(CAST(arg_max(weight, event_us * 10 + stage) AS DECIMAL(3, 2)) AS VARCHAR) FROM degraded GROUP BY region""")
def stream_whole_feed(spark: SparkSession, d: str) -> DataFrame:
    """The whole change feed as one stream, folded: links and regions by a reader of all frames, links by a subscriber who
    begins in the middle with the table of live links."""
    regions = stored(t.regions(spark, d))

    def start(path: str) -> StreamingQuery:
        rows = streams.whole_feed(_updates(spark, path), TTL, SWEEP, 3 * D)
        return _to_batches(rows, streams.whole_feed_batches(f"{path}/feed", regions, versions=100, **CHURN), path)

    path = _run(spark, d, start)
    frames = stored(streams.feed_frames(spark, f"{path}/feed"))
    name = F.concat_ws("-", "lo", "hi").alias("name")
    links = feed.current_links(frames).select(F.lit("links").alias("part"), name, F.col("since_us").cast("string").alias("value"))
    areas = feed.region_severity(frames).select(F.lit("regions").alias("part"), F.col("region").alias("name"), F.col("severity").cast("decimal(3,2)").cast("string").alias("value"))
    middle = (frames.agg(F.max("batch")).first()[0] or 0) // 2
    read = streams.subscription_at(spark, f"{path}/feed", middle).withColumn("frame", F.from_json("value", "kind string, a long, b long"))
    read = topology.canonical_edge(read.filter("frame.a is not null").select("batch", *feed.ORDER, "frame.*"))
    last = read.groupBy("lo", "hi").agg(F.max_by("kind", F.struct("batch", *feed.ORDER)).alias("kind")).filter(F.col("kind") == feed.LINK_UP)
    return links.union(areas).union(last.select(F.lit("subscriber"), name, F.lit("")))


@query("SELECT CAST(count(*) AS BIGINT) AS messages, min(event_us) AS first_us, max(event_us) AS last_us FROM msg")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """Live counters of a stream, a row a batch, summed up."""

    def start(path: str) -> StreamingQuery:
        sink = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/out/{number}")
        return _to_batches(_updates(spark, path).select("msg_id", "event_us"), streams.counted_batches(sink, f"{path}/counters"), path)

    path = _run(spark, d, start)
    rows = spark.read.schema("batch long, messages long, first_us long, last_us long").option("recursiveFileLookup", "true").parquet(f"{path}/counters")
    return rows.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


@query("SELECT kind, CAST(day AS VARCHAR) AS day, count(*) AS n FROM history GROUP BY 1, 2")
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies written to a folder day by day and followed from there into the history."""
    from asnwatch.operators import history

    path = t.scratch(spark, "stream")
    found = batch_anomalies(spark, d)
    found.write.parquet(f"{path}/anomalies")
    stored = spark.read.schema(found.schema).parquet(f"{path}/anomalies")
    for k in range(SLICES):
        stored.filter(F.col("msg_id") % SLICES == k).write.mode("append").parquet(f"{path}/arriving")
        rows = spark.readStream.schema(found.schema).parquet(f"{path}/arriving")
        _to_batches(rows, streams.history_batches(f"{path}/history"), path).awaitTermination()
    kept = history.read_history(spark, f"{path}/history")
    return kept.groupBy("kind", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
