"""Registered queries: every operator over the derived tables, with wide parameters as events lie hours apart."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.functions.messages import event_us
from asnwatch.functions.prefixes import network_key, normalise_prefixes
from asnwatch.operators import detect, feed, geo, history, lookup, monitor, origins, routes, topology
from asnwatch.operators.spread import side_by_side, stored
from asnwatch.plans import tables as t
from asnwatch.plans.sql import D, H, sql
from asnwatch.schemas import UPDATES
from asnwatch.sources import monitor as monitor_source
from asnwatch.sources import relationships as rel_source
from asnwatch.sources import updates as update_source

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TTL, SWEEP = 2 * D, D
LEAK_WINDOW = D
CHURN = {"min_updates": 3, "deviations": 2.0, "floor": 3.0, "bucket_us": H}


def query(oracle: str | None = None, decoded: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(" ".join(oracle.split()), decoded)
        return f

    return register


def _text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _ops(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    return routes.route_ops(t.updates(spark, d) if messages is None else messages)


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    return rel_source.parse_as_relationships(t.relationship_lines(spark, d))


def _episodes(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    as_of = t.table(spark, d, "events").agg(F.max(t.micros())).first()[0] or 0
    return stored(topology.edge_episodes(topology.path_edges(t.updates(spark, d) if messages is None else messages), TTL, SWEEP, as_of, D))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return topology.current_edges(_episodes(spark, d))


def _hijacks(spark: SparkSession, d: str, ops: DataFrame | None = None) -> DataFrame:
    return detect.detect_hijacks(origins.origin_observations(stored(_ops(spark, d)) if ops is None else ops, spread_us=D))


def _path_leaks(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    return detect.path_leaks(detect.valley_apexes(t.updates(spark, d) if messages is None else messages, _relationships(spark, d)))


def _leaks(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    return detect.suppress_repeats(stored(_path_leaks(spark, d, messages)), LEAK_WINDOW, D)


def _vantage(spark: SparkSession, d: str, ops: DataFrame | None = None) -> DataFrame:
    return detect.vantage_counts(stored(_ops(spark, d)) if ops is None else ops, 3 * D, D)


def _churn(spark: SparkSession, d: str, ops: DataFrame | None = None) -> DataFrame:
    judged = stored(detect.churn_threshold(stored(_vantage(spark, d, ops)), **CHURN))
    return detect.detect_churn(judged, CHURN["min_updates"], spread_us=D)


def _anomalies(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    """All kinds, hijacks and churn from one stored table of operations. The detectors store what they read twice and what they
    find, few rows that are read for regions, ranges and counts; they do so side by side, as none of them fills a cluster on its own."""
    ops = stored(_ops(spark, d, messages))
    kinds = side_by_side(lambda: stored(_hijacks(spark, d, ops)), lambda: stored(_leaks(spark, d, messages)), lambda: stored(_churn(spark, d, ops)))
    return detect.anomalies(*kinds)


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.to_history(geo.resolve_region(_anomalies(spark, d), t.regions(spark, d)))


def _areas(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    return geo.area_degraded(_anomalies(spark, d, messages), t.regions(spark, d))


def _deltas(spark: SparkSession, d: str, messages: DataFrame | None = None) -> DataFrame:
    episodes, areas = side_by_side(lambda: _episodes(spark, d, messages), lambda: _areas(spark, d, messages))
    return feed.deltas(topology.link_up(episodes), topology.link_down(episodes), areas)


def _link_frames(spark: SparkSession, d: str) -> DataFrame:
    """The feed's frames of links, all that a reader of links alone keeps of it."""
    episodes = _episodes(spark, d)
    return feed.deltas(topology.link_up(episodes), topology.link_down(episodes))


# Feed messages


@query("""SELECT CASE WHEN m % 40 = 5 THEN 'control' WHEN m % 41 = 6 OR (m % 50 = 3 AND NOT withdraws) THEN 'quarantine' ELSE 'routing' END AS outcome, count(*) AS n_frames FROM msg GROUP BY 1""")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return update_source.frame_counts(t.frames(spark, d))


@query("""SELECT msg_id, event_us, peer_asn, CASE WHEN m % 9 = 0 THEN 'OTHER' ELSE 'UPDATE' END AS msg_type,
    CASE WHEN withdraws THEN '' ELSE concat_ws(',', peer_asn, t1, t2) || CASE WHEN m % 10 = 0 THEN ',' || t2 ELSE '' END || ',' || origin || CASE WHEN m % 6 = 1 THEN ',64999' ELSE '' END END AS path,
    CASE WHEN withdraws THEN NULL WHEN m % 6 = 1 THEN 64999 ELSE origin END AS origin_asn, CASE WHEN withdraws THEN 0 ELSE 1 END AS n_announced, CASE WHEN withdraws THEN 1 ELSE 0 END AS n_withdrawn
    FROM msg WHERE NOT (m % 40 = 5 OR m % 41 = 6 OR (m % 50 = 3 AND NOT withdraws))""")
def read_updates(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = update_source.split_frames(t.frames(spark, d))
    rows = routes.with_origin_asn(rows)
    return rows.select("msg_id", "event_us", "peer_asn", "msg_type", _text("path").alias("path"), "origin_asn", F.size("announcements").alias("n_announced"), F.size("withdrawals").alias("n_withdrawn"))


FILES = 4
_READ_SQL = f"""SELECT (msg_id % {FILES}) * {1 << update_source.LINE_BITS} + line AS msg_id, event_us, peer_asn, CASE WHEN m % 9 = 0 THEN 'OTHER' ELSE 'UPDATE' END AS msg_type,
    CASE WHEN withdraws THEN '' ELSE concat_ws(',', peer_asn, t1, t2) || CASE WHEN m % 10 = 0 THEN ',' || t2 ELSE '' END || ',' || origin || CASE WHEN m % 6 = 1 THEN ',64999' ELSE '' END END AS path
    FROM (SELECT *, row_number() OVER (PARTITION BY msg_id % {FILES} ORDER BY msg_id) - 1 AS line FROM msg) WHERE NOT (m % 40 = 5 OR m % 41 = 6 OR (m % 50 = 3 AND NOT withdraws))"""


def _write_frames(spark: SparkSession, d: str, path: str, k: int) -> None:
    """The frames of file ``k`` of FILES, in order, as one text file. One task writes it; what that sorts are the fields of
    events, of which it makes the much longer frames as it writes them."""
    events = t.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").filter(F.col("event_id") % FILES == k)
    t.frame_rows(events.repartition(1).sortWithinPartitions("event_id")).select("value").write.text(f"{path}/file={k}")


@query(_READ_SQL)
def read_update_files(spark: SparkSession, d: str) -> DataFrame:
    """The frames written as text files and read from there, numbered by file and line."""
    path = t.scratch(spark, "frames")
    side_by_side(*[partial(_write_frames, spark, d, path, k) for k in range(FILES)])
    return update_source.read_updates(spark, path).select("msg_id", "event_us", "peer_asn", "msg_type", _text("path").alias("path"))


@query(_READ_SQL)
def stream_update_files(spark: SparkSession, d: str) -> DataFrame:
    """The same files followed as a stream, one arriving after the other, to the table of numbered updates."""
    path = t.scratch(spark, "frames")
    for k in range(FILES):
        _write_frames(spark, d, f"{path}/in", k)
        run = update_source.numbered_batches(update_source.update_batches(f"{path}/updates"), f"{path}/numbers")
        writer = update_source.stream_frames(spark, f"{path}/in/*").writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(UPDATES).parquet(f"{path}/updates")
    return rows.select("msg_id", "event_us", "peer_asn", "msg_type", _text("path").alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_us + 7 ELSE event_us END AS used_us FROM ev")
def event_time(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").withColumn("us", t.micros())
    stamp = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("us") / 1_000_000)
    return rows.select("event_id", event_us(stamp, F.col("us") + 7).alias("used_us"))


@query("SELECT msg_id, event_us, pos, op, prefix, family, prefix_len, net_key, peer_asn, origin_asn FROM ops")
def route_ops(spark: SparkSession, d: str) -> DataFrame:
    return _ops(spark, d).select("msg_id", "event_us", "pos", "op", "prefix", F.col("family").cast("int").alias("family"), "prefix_len", "net_key", "peer_asn", "origin_asn")


@query("SELECT op, prefix, count(*) AS n FROM ops GROUP BY op, prefix")
def announced_and_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    rows = t.updates(spark, d)
    both = routes.announced_prefixes(rows).withColumn("op", F.lit("A")).unionByName(routes.withdrawn_prefixes(rows).withColumn("op", F.lit("W")))
    return both.groupBy("op", "prefix").agg(F.count("*").alias("n"))


@query("SELECT msg_id, peer_asn FROM msg WHERE m % 3 = 1")
def filter_collector(spark: SparkSession, d: str) -> DataFrame:
    return routes.filter_collector(t.updates(spark, d), "rrc01").select("msg_id", "peer_asn")


@query("SELECT msg_id, peer_asn FROM msg WHERE NOT withdraws AND (t1 = 105 OR t2 = 105 OR origin = 105)")
def filter_path_asn(spark: SparkSession, d: str) -> DataFrame:
    return routes.filter_path_asn(t.updates(spark, d), 105).select("msg_id", "peer_asn")


@query("""SELECT 'exact' AS mode, msg_id FROM ops WHERE prefix = '10.1.0.0/16'
    UNION ALL SELECT 'more', msg_id FROM ops WHERE starts_with(net_key, '0000101000000001')
    UNION ALL SELECT 'less', msg_id FROM ops WHERE starts_with('000010100000001100000000', net_key)""")
def filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = t.updates(spark, d)
    modes = {"exact": ("10.1.0.0/16", {}), "more": ("10.1.0.0/16", {"more_specific": True}), "less": ("10.3.0.0/24", {"less_specific": True})}
    parts = [routes.filter_prefix(rows, p, **flags).select(F.lit(mode).alias("mode"), "msg_id") for mode, (p, flags) in modes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT DISTINCT '2001:db8:' || printf('%x', uid) || CASE WHEN uid % 2 = 0 THEN '::/48' ELSE ':0:0:0:0:0/64' END AS prefix, 6 AS family, CASE WHEN uid % 2 = 0 THEN 48 ELSE 64 END AS prefix_len,
    '00100000000000010000110110111000' || lpad(bin(uid), 16, '0') || CASE WHEN uid % 2 = 0 THEN '' ELSE '0000000000000000' END AS net_key FROM ev""")
def normalise_prefixes_v6(spark: SparkSession, d: str) -> DataFrame:
    rows = t.event_fields(t.table(spark, d, "events")).selectExpr("concat('2001:db8:', lower(hex(uid)), case when uid % 2 = 0 then '::/48' else ':0:0:0:0:0/64' end) as prefix").distinct()
    return normalise_prefixes(rows).withColumn("family", F.col("family").cast("int"))


# Relationship datasets


@query("SELECT a, b, rel FROM rels")
def as_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _relationships(spark, d)


@query("SELECT a, b, rel FROM rels")
def read_relationship_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines written as compressed text files and read from there."""
    path = t.scratch(spark, "relationships")
    t.relationship_lines(spark, d).select("value").write.option("compression", "bzip2").text(path)
    return rel_source.read_as_relationships(spark, path)


@query("SELECT a, b, rel, '2024-02-01' AS snapshot FROM pairs WHERE (a * 4294967296 + b) % 4 = 1")
def latest_relationship_snapshot(spark: SparkSession, d: str) -> DataFrame:
    files = ["data/20240101.as-rel.txt.bz2", "data/20240201.as-rel2.txt.bz2", "data/20240301.as-rel2.txt.bz2", "data/20240210.as-rel.v6.txt.bz2"]
    lines = t.relationship_lines(spark, d).withColumn("file", F.get(F.array(*[F.lit(f) for f in files]), (F.col("line_no") % 4).cast("int")))
    part = F.split("value", r"\|")
    return rel_source.latest_relationship_snapshot(lines, "2024-02-15").select(part[0].cast("bigint").alias("a"), part[1].cast("bigint").alias("b"), part[2].alias("rel"), F.col("snapshot").cast("string").alias("snapshot"))


@query("SELECT DISTINCT h.a, h.b, coalesce(s.rel, 'unknown') AS rel FROM edges h LEFT JOIN sides s ON s.a = h.a AND s.b = h.b")
def relationship_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = topology.path_edges(t.updates(spark, d)).select("a", "b").distinct()
    return detect.relationship_lookup(pairs, _relationships(spark, d))


@query("""SELECT DISTINCT h.a, h.b, CASE WHEN coalesce(x.n, 0) = 0 OR coalesce(y.n, 0) = 0 THEN 'unknown' WHEN x.n >= 4 * y.n THEN 'provider' WHEN y.n >= 4 * x.n THEN 'customer' ELSE 'peer' END AS rel
    FROM edges h LEFT JOIN (SELECT asn, count(*) AS n FROM ends GROUP BY asn) x ON x.asn = h.a LEFT JOIN (SELECT asn, count(*) AS n FROM ends GROUP BY asn) y ON y.asn = h.b""")
def resolve_relationships(spark: SparkSession, d: str) -> DataFrame:
    pairs = topology.path_edges(t.updates(spark, d)).select("a", "b").distinct()
    return detect.resolve_relationships(pairs, rel_source.empty_relationships(spark), topology.degree(_live(spark, d)))


# The graph


@query("SELECT msg_id, event_us, CAST(hop AS INTEGER) AS hop, a, b, lo, hi FROM edges")
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.path_edges(t.updates(spark, d))


@query("SELECT lo, hi, a, b, up_us, last_seen_us, down_us FROM episodes")
def edge_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).select("lo", "hi", "a", "b", "up_us", "last_seen_us", "down_us")


@query("SELECT 'up' AS change, a, b, up_us AS event_us FROM episodes UNION ALL SELECT 'down', lo, hi, down_us FROM episodes WHERE down_us IS NOT NULL")
def link_changes(spark: SparkSession, d: str) -> DataFrame:
    episodes = _episodes(spark, d)
    up = topology.link_up(episodes).select(F.lit("up").alias("change"), "a", "b", "event_us")
    return up.union(topology.link_down(episodes).select(F.lit("down"), "a", "b", "event_us"))


@query("SELECT lo, hi, (lo + hi) % 3 = 0 AS removed FROM live")
def remove_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _live(spark, d)
    left, gone = topology.remove_edges(edges, edges.filter("(lo + hi) % 3 = 0").select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    return left.select("lo", "hi", F.lit(False).alias("removed")).union(gone.select("lo", "hi", F.lit(True)))


@query("SELECT asn, array_to_string(list_sort(list(DISTINCT peer)), ',') AS peers FROM ends GROUP BY asn")
def peers(spark: SparkSession, d: str) -> DataFrame:
    return topology.peers(_live(spark, d)).select("asn", _text("peers").alias("peers"))


@query("SELECT a.asn, count(e.peer) AS degree FROM (SELECT DISTINCT origin + 1 AS asn FROM msg) a LEFT JOIN ends e USING (asn) GROUP BY a.asn")
def degree(spark: SparkSession, d: str) -> DataFrame:
    asked = t.event_fields(t.table(spark, d, "events")).select((F.col("origin") + 1).alias("asn"))
    return topology.degree(_live(spark, d), asked)


@query("""SELECT asn, count(DISTINCT peer) AS degree FROM (SELECT l_suppkey AS asn, l_partkey + 10000000 AS peer FROM lineitem UNION ALL SELECT l_partkey + 10000000, l_suppkey FROM lineitem) GROUP BY asn""")
def supply_degree(spark: SparkSession, d: str) -> DataFrame:
    return topology.degree(t.supply_edges(spark, d))


@query("SELECT m.asn, m.event_us, m.msg_id, CAST(m.n AS BIGINT) AS degree FROM moments m")
def degree_asof(spark: SparkSession, d: str) -> DataFrame:
    probes = t.updates(spark, d).select(F.explode(F.array_distinct("path")).alias("asn"), "event_us", "msg_id")
    return topology.degree_asof(_episodes(spark, d), probes, bucket_us=D)


@query("SELECT (SELECT count(DISTINCT asn) FROM ends) AS n_asns, (SELECT count(*) FROM live) AS n_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return topology.graph_counts(_live(spark, d))


@query("SELECT lo, hi, last_seen_us FROM live ORDER BY last_seen_us DESC, lo, hi LIMIT 100")
def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.snapshot_edges(_live(spark, d), 100).select("lo", "hi", "last_seen_us")


# Origins of prefixes


@query("SELECT msg_id, prefix, net_key, previous_origin, origin_asn AS new_origin, changed, distinct_origins FROM observed")
def origin_observations(spark: SparkSession, d: str) -> DataFrame:
    return origins.origin_observations(stored(_ops(spark, d)), spread_us=D).select("msg_id", "prefix", "net_key", "previous_origin", "new_origin", "changed", "distinct_origins")


@query("SELECT net_key, max(segment) AS n_withdrawals, count(*) AS n_ops FROM segments GROUP BY net_key")
def apply_withdrawals(spark: SparkSession, d: str) -> DataFrame:
    return origins.apply_withdrawals(_ops(spark, d), D).groupBy("net_key").agg(F.max("segment").alias("n_withdrawals"), F.count("*").alias("n_ops"))


@query("""SELECT net_key, arg_max(origin_asn, event_us) AS origin, array_to_string(list(origin_asn ORDER BY event_us) FILTER (is_first AND rk <= 16), ',') AS origins
    FROM (SELECT *, max(segment) OVER (PARTITION BY net_key) AS newest FROM (SELECT r.*, s.newest_segment FROM ranked r JOIN (SELECT net_key, max(segment) AS newest_segment FROM segments GROUP BY net_key) s USING (net_key)) WHERE segment = newest_segment) GROUP BY net_key""")
def prefix_origins(spark: SparkSession, d: str) -> DataFrame:
    return origins.prefix_origins(_ops(spark, d), spread_us=D).select("net_key", "origin", _text("origins").alias("origins"))


@query("""SELECT p.address AS net_key, max(e.prefix_len) AS matched_len, arg_max(e.origin, e.prefix_len) AS origin FROM (SELECT DISTINCT address FROM nets) p
    LEFT JOIN (SELECT net_key, any_value(prefix_len) AS prefix_len, arg_max(origin_asn, event_us) AS origin FROM ops WHERE op = 'A' GROUP BY net_key) e ON starts_with(p.address, e.net_key) GROUP BY p.address""")
def longest_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    ops = _ops(spark, d)
    table = ops.filter("op = 'A'").groupBy("family", "net_key", "prefix_len").agg(F.max_by("origin_asn", "event_us").alias("origin"))
    probes = ops.select("family", network_key(F.col("net_key"), F.col("family")).alias("net_key")).distinct()
    return lookup.longest_prefix_match(probes, table, ["origin"]).select("net_key", "matched_len", "origin")


# Detectors


@query("SELECT make_timestamp(event_us) AS observed_at, 'prefix_hijack' AS kind, severity, prefix, previous_origin, origin_asn AS new_origin FROM hijacks")
def origin_hijacks(spark: SparkSession, d: str) -> DataFrame:
    return history.to_history(detect.anomalies(_hijacks(spark, d))).select("observed_at", "kind", "severity", "prefix", "previous_origin", "new_origin")


@query("SELECT msg_id, CAST(i AS INTEGER) AS i, y, learned_from, told FROM apexes")
def valley_apexes(spark: SparkSession, d: str) -> DataFrame:
    return detect.valley_apexes(t.updates(spark, d), _relationships(spark, d)).select("msg_id", "i", "y", "learned_from", "told")


@query("SELECT msg_id, offending_asn, violations, severity FROM leaks")
def path_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _path_leaks(spark, d).select("msg_id", "offending_asn", "violations", "severity")


@query("""SELECT msg_id, max_by(y, i) AS offending_asn, CAST(count(*) AS INTEGER) AS violations FROM (
        SELECT t.*, CASE WHEN y.n <= 0 OR f.n <= 0 THEN 'unknown' WHEN y.n >= 4 * f.n THEN 'provider' WHEN f.n >= 4 * y.n THEN 'customer' ELSE 'peer' END AS rel_in,
            CASE WHEN y.n <= 0 OR o.n <= 0 THEN 'unknown' WHEN y.n >= 4 * o.n THEN 'provider' WHEN o.n >= 4 * y.n THEN 'customer' ELSE 'peer' END AS rel_out
        FROM triples t JOIN moments y ON y.msg_id = t.msg_id AND y.asn = t.y JOIN moments f ON f.msg_id = t.msg_id AND f.asn = t.learned_from JOIN moments o ON o.msg_id = t.msg_id AND o.asn = t.told)
    WHERE rel_in IN ('customer', 'peer') AND rel_out IN ('customer', 'peer') GROUP BY msg_id""")
def path_leaks_by_degree(spark: SparkSession, d: str) -> DataFrame:
    apexes = detect.valley_apexes_by_degree(t.updates(spark, d), _episodes(spark, d), bucket_us=D)
    return detect.path_leaks(apexes).select("msg_id", "offending_asn", "violations")


@query("SELECT msg_id, event_us, offending_asn, severity FROM reported")
def reported_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("msg_id", "event_us", "offending_asn", "severity")


@query("SELECT msg_id, prefix, peer_asn, CAST(nth AS INTEGER) AS nth, n_updates FROM vantage")
def vantage_counts(spark: SparkSession, d: str) -> DataFrame:
    return _vantage(spark, d).select("msg_id", "prefix", "peer_asn", "nth", "n_updates")


@query("SELECT i.msg_id, i.n_updates, round(t.threshold, 6) AS threshold FROM indexed i LEFT JOIN thresholds t USING (g)")
def churn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return detect.churn_threshold(stored(_vantage(spark, d)), **CHURN).select("msg_id", "n_updates", F.round("threshold", 6).alias("threshold"))


@query("SELECT msg_id, prefix, peer_asn, n_updates, round(threshold, 6) AS threshold, severity FROM churn")
def route_churn(spark: SparkSession, d: str) -> DataFrame:
    return _churn(spark, d).select("msg_id", "prefix", "peer_asn", "n_updates", F.round("threshold", 6).alias("threshold"), "severity")


@query("SELECT msg_id, event_us, kind, severity, prefix, new_origin, offending_asn, updates_in_window, [0.33, 0.66, 1.0][severity + 1]::FLOAT AS severity_index FROM anomalies")
def all_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return geo.with_severity_index(_anomalies(spark, d)).select("msg_id", "event_us", "kind", "severity", "prefix", "new_origin", "offending_asn", "updates_in_window", "severity_index")


# Regions


@query("SELECT n.net_key, a.region FROM nets n LEFT JOIN areas a USING (net_key)")
def resolve_region(spark: SparkSession, d: str) -> DataFrame:
    return geo.resolve_region(_ops(spark, d).select("family", "net_key").distinct(), t.regions(spark, d)).select("net_key", "region")


@query("""SELECT n.net_key, arg_max(b.asn, b.prefix_len) AS asn FROM nets n LEFT JOIN (SELECT net_key, prefix_len, 64000 + prefix_len AS asn FROM blocks) b ON starts_with(n.address, b.net_key) GROUP BY n.net_key""")
def resolve_asn(spark: SparkSession, d: str) -> DataFrame:
    blocks = t.regions(spark, d).select("family", "prefix_len", "net_key", (F.col("prefix_len") + 64000).cast("bigint").alias("asn"))
    return geo.resolve_asn(_ops(spark, d).select("family", "net_key").distinct(), blocks).select("net_key", "asn")


@query("SELECT msg_id, kind, prefix, region, weight AS severity_index FROM degraded")
def area_degraded(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("msg_id", "kind", "prefix", "region", "severity_index")


# The change feed


@query("SELECT event_us, msg_id, CAST(stage AS INTEGER) AS stage, kind, a, b, region, severity FROM deltas")
def deltas(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("event_us", "msg_id", "stage", "kind", "a", "b", "region", "severity")


@query("SELECT event_us, msg_id, CAST(stage AS INTEGER) AS stage, kind, a, b, region, severity FROM deltas", decoded=True)
def frames_to_deltas(spark: SparkSession, d: str) -> DataFrame:
    """From JSON frames to the change feed in one run: decoded once, stored, and read by all detectors."""
    messages = stored(update_source.split_frames(t.frames(spark, d))[0])
    return _deltas(spark, d, messages).select("event_us", "msg_id", "stage", "kind", "a", "b", "region", "severity")


@query("""SELECT event_us, CASE kind WHEN 'AreaDegraded' THEN '{"kind":"AreaDegraded","region":"' || region || '","severity":' || severity || '}' ELSE '{"kind":"' || kind || '","a":' || a || ',"b":' || b || '}' END AS value FROM deltas""")
def delta_frames(spark: SparkSession, d: str) -> DataFrame:
    return feed.delta_frames(_deltas(spark, d)).select("event_us", "value")


@query("""SELECT kind, count(*) AS n_frames, CAST(sum(len(CASE kind WHEN 'AreaDegraded' THEN '{"kind":"AreaDegraded","region":"' || region || '","severity":' || severity || '}' ELSE '{"kind":"' || kind || '","a":' || a || ',"b":' || b || '}' END)) AS BIGINT) AS n_bytes FROM deltas GROUP BY kind""")
def delta_counts(spark: SparkSession, d: str) -> DataFrame:
    return feed.delta_counts(_deltas(spark, d))


@query("SELECT lo, hi, up_us AS since_us FROM live")
def current_links(spark: SparkSession, d: str) -> DataFrame:
    return feed.current_links(_link_frames(spark, d))


@query("SELECT DISTINCT asn FROM ends")
def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    return feed.current_nodes(feed.current_links(_link_frames(spark, d)))


@query("SELECT region, arg_max(weight, event_us * 10 + stage) AS severity FROM degraded GROUP BY region")
def region_severity(spark: SparkSession, d: str) -> DataFrame:
    return feed.region_severity(feed.deltas(areas=_areas(spark, d)))


@query("""SELECT '{"kind":"LinkUp","a":' || lo || ',"b":' || hi || '}' AS value FROM live ORDER BY last_seen_us DESC, lo, hi LIMIT 50""")
def snapshot_frames(spark: SparkSession, d: str) -> DataFrame:
    return feed.delta_frames(feed.snapshot_frames(_live(spark, d), 50)).select("value")


# History


@query("SELECT observed_at, CAST(day AS VARCHAR) AS day, kind, severity, prefix, previous_origin, new_origin, offending_asn, region, updates_in_window FROM history")
def anomaly_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("observed_at", F.col("day").cast("string").alias("day"), "kind", "severity", "prefix", "previous_origin", "new_origin", "offending_asn", "region", "updates_in_window")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The history written by day and read again, in a folder of its own beside the checkpoints."""
    path = t.scratch(spark, "history")
    history.write_history(_history(spark, d), path)
    return history.read_history(spark, path)


@query("""SELECT kind, severity, prefix, region, CAST(day AS VARCHAR) AS day FROM history WHERE starts_with(net_key, '0000101000000001') OR starts_with('0000101000000001', net_key)""")
def history_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return history.history_query(_stored(spark, d), prefix="10.1.0.0/16").select("kind", "severity", "prefix", "region", F.col("day").cast("string").alias("day"))


@query("""SELECT kind, severity, prefix, offending_asn, CAST(day AS VARCHAR) AS day FROM history WHERE severity >= 2 AND observed_at >= TIMESTAMP '2024-01-05 06:00:00' AND observed_at < TIMESTAMP '2024-01-20 00:00:00'""")
def history_by_time(spark: SparkSession, d: str) -> DataFrame:
    rows = history.history_query(_stored(spark, d), min_severity=2, since="2024-01-05 06:00:00", until="2024-01-20 00:00:00")
    return rows.select("kind", "severity", "prefix", "offending_asn", F.col("day").cast("string").alias("day"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, observed_at) AS bucket_start, kind, count(*) AS n, max(severity) AS max_severity FROM history GROUP BY 1, 2")
def history_timeseries(spark: SparkSession, d: str) -> DataFrame:
    return history.history_timeseries(_history(spark, d), "6 hours")


_MANIFEST = "(SELECT CAST(make_timestamp(event_us) AS DATE) AS day, CAST(sum(1000 + m % 77) AS BIGINT) AS bytes FROM ev GROUP BY 1)"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = t.event_fields(t.table(spark, d, "events"))
    return history.with_day(rows.withColumn("at", F.timestamp_micros("event_us")), "at").groupBy("day").agg(F.sum(1000 + F.col("m") % 77).alias("bytes"))


@query(f"SELECT CAST(day AS VARCHAR) AS day, bytes, 'age' AS why FROM {_MANIFEST} WHERE day < DATE '2024-01-10' UNION ALL SELECT CAST(day AS VARCHAR), bytes, 'size' FROM (SELECT *, sum(bytes) OVER (ORDER BY day DESC) AS kept, row_number() OVER (ORDER BY day DESC) AS rn FROM {_MANIFEST}) WHERE kept > 200000 AND rn > 1")
def prune_days(spark: SparkSession, d: str) -> DataFrame:
    days = _manifest(spark, d)
    old = history.prune_by_age(days, F.lit("2024-02-09").cast("timestamp"), 30)
    both = old.withColumn("why", F.lit("age")).union(history.prune_by_size(days, 200_000).withColumn("why", F.lit("size")))
    return both.withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT count(*) FILTER (gone) AS days_dropped, CAST(coalesce(sum(bytes) FILTER (NOT gone), 0) AS BIGINT) AS bytes_left FROM (SELECT bytes, day < DATE '2024-01-10' OR (kept > 200000 AND rn > 1) AS gone FROM (
    SELECT *, sum(bytes) OVER (ORDER BY day DESC) AS kept, row_number() OVER (ORDER BY day DESC) AS rn FROM {_MANIFEST}))""")
def prune_outcome(spark: SparkSession, d: str) -> DataFrame:
    return history.prune_outcome(_manifest(spark, d), F.lit("2024-02-09").cast("timestamp"), 30, 200_000)


# Monitoring


@query("SELECT * FROM samples")
def monitor_samples(spark: SparkSession, d: str) -> DataFrame:
    return monitor_source.clean_samples(t.monitor_samples(spark, d))


@query("SELECT * FROM samples")
def read_sample_files(spark: SparkSession, d: str) -> DataFrame:
    """The samples written as CSV files and read from there."""
    path = t.scratch(spark, "samples")
    t.monitor_samples(spark, d).write.option("header", True).csv(path)
    return monitor_source.read_monitor_samples(spark, path)


@query("""SELECT run_id, scrape_ts, CAST(max(event_id) AS BIGINT) AS msgs,
    coalesce(arg_max(event_id % 91, event_id) FILTER (event_id % 3 = 0), 0) AS hijack, coalesce(arg_max(event_id % 91, event_id) FILTER (event_id % 3 = 1), 0) AS leak, coalesce(arg_max(event_id % 91, event_id) FILTER (event_id % 3 = 2), 0) AS churn,
    coalesce(max(1200) FILTER (event_id % 4 = 1), 0) AS nodes, coalesce(arg_max(event_id % 17, event_id) FILTER (event_id % 4 = 2), 0) AS edges, 0 AS dropped, 0 AS deltas, 0 AS clients
    FROM (SELECT CAST(user_id % 10 AS VARCHAR) AS run_id, event_us // 60000000 AS scrape_ts, event_id FROM ev) GROUP BY run_id, scrape_ts""")
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    return monitor_source.metrics_text_to_samples(t.metrics_text(spark, d))


@query("""SELECT bucket_start, counter, count(*) AS n FROM (SELECT date_trunc('day', make_timestamp(event_us)) AS bucket_start, 'messages' AS counter FROM msg UNION ALL SELECT date_trunc('day', make_timestamp(event_us)), 'anomalies:' || kind FROM anomalies
    UNION ALL SELECT date_trunc('day', make_timestamp(event_us)), 'deltas' FROM deltas) GROUP BY 1, 2""")
def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    episodes, anomalies = side_by_side(lambda: _episodes(spark, d), lambda: _anomalies(spark, d))
    frames = feed.deltas(topology.link_up(episodes), topology.link_down(episodes), geo.area_degraded(anomalies, t.regions(spark, d)))
    return monitor.pipeline_counters(t.updates(spark, d), anomalies, frames)


@query("""SELECT run_id, samples, window_s, round(ticks / 100.0 / window_s * 100, 6) AS cpu_core_pct, round(rss_avg_mib, 6) AS rss_avg_mib, round(rss_peak_mib, 6) AS rss_peak_mib, measured, reconnected, round(rx / window_s / 1024, 6) AS ingress_kib_s, msgs_total,
    round(msgs_total / window_s, 6) AS msgs_per_s, round(CASE WHEN msgs_total > 0 AND measured THEN rx / msgs_total END, 6) AS bytes_per_msg, dropped, round(CASE WHEN msgs_total + dropped > 0 THEN dropped / (msgs_total + dropped) * 100 ELSE 0.0 END, 6) AS drop_ratio_pct, clients_peak FROM summary""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = monitor.run_summary(monitor_source.clean_samples(t.monitor_samples(spark, d)))
    rounded = {c: F.round(c, 6) for c in ("cpu_core_pct", "rss_avg_mib", "rss_peak_mib", "ingress_kib_s", "msgs_per_s", "bytes_per_msg", "drop_ratio_pct")}
    return rows.withColumns(rounded).drop("cpu_host_pct")


@query("SELECT run_id, measured, CAST(rx AS BIGINT) AS delta, reconnected AS reset FROM summary")
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    return monitor.counter_delta_with_reset(monitor_source.clean_samples(t.monitor_samples(spark, d)))


@query("""SELECT run_id, elapsed_s, msgs, round(coalesce(greatest(msgs - lag(msgs) OVER w, 0) / greatest(elapsed_s - lag(elapsed_s) OVER w, 1), 0.0), 6) AS msgs_per_s FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY elapsed_s) - 1 AS i, greatest(count(*) OVER (PARTITION BY run_id) // 12, 1) AS step FROM samples) WHERE i % step = 0 WINDOW w AS (PARTITION BY run_id ORDER BY elapsed_s)""")
def rate_series(spark: SparkSession, d: str) -> DataFrame:
    return monitor.rate_series(t.monitor_samples(spark, d), span_s=500).select("run_id", "elapsed_s", "msgs", F.round("msgs_per_s", 6).alias("msgs_per_s"))


@query("SELECT * FROM logsum")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitor.log_summary(t.log_lines(spark, d))


@query("""SELECT run_id, 'head' AS part, CAST(place AS INTEGER) AS place, line FROM (SELECT *, 't' || line_no || ' ' || level || ' ' || said AS line, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS place FROM loglines) WHERE place <= 25
    UNION ALL SELECT run_id, 'problem', CAST(place AS INTEGER), line FROM (SELECT *, 't' || line_no || ' ' || level || ' ' || said AS line, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS place FROM loglines WHERE level <> 'INFO') WHERE place <= 20""")
def log_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return monitor.log_excerpt(t.log_lines(spark, d))


@query("""SELECT s.run_id, CASE WHEN s.run_id = '9' OR l.panics > 0 THEN 'FAIL' WHEN s.msgs_total = 0 OR l.error > 0 OR (s.msgs_total + s.dropped > 0 AND s.dropped / (s.msgs_total + s.dropped) * 100 > 1) THEN 'WARN' ELSE 'PASS' END AS verdict
    FROM summary s LEFT JOIN logsum l USING (run_id)""")
def run_verdict(spark: SparkSession, d: str) -> DataFrame:
    samples = monitor_source.clean_samples(t.monitor_samples(spark, d))
    died = samples.filter("run_id = '9'").select("run_id").distinct()
    return monitor.run_verdict(monitor.run_summary(samples), monitor.log_summary(t.log_lines(spark, d)), died)
