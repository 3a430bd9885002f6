import datetime as dt
import json

from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.operators import feed, geo, history, lookup, monitor
from asnwatch.sources import blocks, relationships
from asnwatch.sources import monitor as monitor_source
from asnwatch.streaming import streams


def prefixes(spark, *texts):
    return normalise_prefixes(spark.createDataFrame([(x,) for x in texts], "prefix string"))


def test_longest_prefix_match(spark):
    table = normalise_prefixes(spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("::/0", 6)], "prefix string, origin long")).drop("prefix")
    got = {r.prefix: (r.matched_len, r.origin) for r in lookup.longest_prefix_match(prefixes(spark, "10.1.2.0/24", "10.2.0.0/24", "10.1.0.0/16", "11.0.0.0/8", "10.0.0.0/7", "2001:db8::/32"), table, ["origin"]).collect()}
    assert got == {"10.1.2.0/24": (16, 2), "10.2.0.0/24": (8, 1), "10.1.0.0/16": (16, 2), "11.0.0.0/8": (None, None), "10.0.0.0/7": (None, None), "2001:db8::/32": (0, 6)}


def geo_blocks(spark):
    rows = [("10.0.0.0/8", "US", None), ("10.1.0.0/16", "US", "CA"), ("10.0.0.0/24", "DE", "BE"), ("10.3.0.0/16", None, "XX")]
    return blocks.geo_blocks(spark.createDataFrame(rows, "network string, country string, subdivision string"))


def test_regions_by_network_address(spark):
    got = {r.prefix: r.region for r in geo.resolve_region(prefixes(spark, "10.1.2.0/24", "10.0.0.0/8", "10.3.1.0/24", "12.0.0.0/8", "10.9.0.0/16"), geo_blocks(spark)).collect()}
    # The /8 probe's own address lies in a longer block.
    assert got == {"10.1.2.0/24": "US-CA", "10.0.0.0/8": "DE-BE", "10.3.1.0/24": None, "12.0.0.0/8": None, "10.9.0.0/16": "US"}


def test_absent_blocks_resolve_nothing(spark, tmp_path):
    empty = blocks.read_geo_blocks(spark, str(tmp_path / "none.csv"))
    assert geo.resolve_region(prefixes(spark, "10.0.0.0/8"), empty).first().region is None
    (tmp_path / "b.csv").write_text("network,country,subdivision\n10.0.0.0/8,US,\nbad,US,\n")
    assert blocks.read_geo_blocks(spark, str(tmp_path / "b.csv")).count() == 1
    (tmp_path / "a.csv").write_text("network,asn\n10.0.0.0/8,15169\n")
    assert geo.resolve_asn(prefixes(spark, "10.2.0.0/16"), blocks.read_asn_blocks(spark, str(tmp_path / "a.csv"))).first().asn == 15169


def test_areas_and_weights(spark):
    rows = spark.createDataFrame([(0, 0, 3, 0, "route_churn", 2, "10.1.0.0/16"), (1, 0, 1, 0, "path_leak", 1, None)], "msg_id long, event_us long, stage int, pos int, kind string, severity short, prefix string")
    got = geo.area_degraded(rows, geo_blocks(spark)).collect()
    assert [(r.region, r.severity_index) for r in got] == [("US-CA", 1.0)]


def deltas(spark):
    rows = [(1, 0, 0, 0, "LinkUp", 1, 2, None, None), (2, 1, 0, 0, "LinkUp", 2, 1, None, None), (3, 2, 0, 0, "LinkUp", 3, 4, None, None), (9, 9, 9, 0, "LinkDown", 3, 4, None, None), (4, 3, 2, 0, "AreaDegraded", None, None, "US", 1.0), (5, 4, 2, 0, "AreaDegraded", None, None, "US", 0.66)]
    return spark.createDataFrame(rows, "event_us long, msg_id long, stage int, pos int, kind string, a long, b long, region string, severity float")


def test_change_feed(spark):
    frames = [json.loads(r.value) for r in feed.delta_frames(deltas(spark)).orderBy("event_us").collect()]
    assert frames[0] == {"kind": "LinkUp", "a": 1, "b": 2}
    assert set(frames[3]) == {"kind", "region", "severity"}
    links = feed.current_links(deltas(spark))
    assert [(r.lo, r.hi) for r in links.collect()] == [(1, 2)]
    assert sorted(r.asn for r in feed.current_nodes(links).collect()) == [1, 2]
    assert [(r.region, round(r.severity, 2)) for r in feed.region_severity(deltas(spark)).collect()] == [("US", 0.66)]
    assert {r.kind: r.n_frames for r in feed.delta_counts(deltas(spark)).collect()} == {"LinkUp": 3, "LinkDown": 1, "AreaDegraded": 2}


def anomaly_rows(spark, *micros):
    rows = [(i, us, 2, 0, "prefix_hijack", 1, "10.1.0.0/16", 4, "0000101000000001", 1, 2) for i, us in enumerate(micros)]
    return spark.createDataFrame(rows, "msg_id long, event_us long, stage int, pos int, kind string, severity short, prefix string, family byte, net_key string, previous_origin long, new_origin long").selectExpr(
        "*", "cast(null as bigint) as offending_asn", "cast(null as array<bigint>) as as_path", "cast(null as int) as updates_in_window", "cast(null as double) as threshold"
    )


def test_history_round_trip_and_retention(spark, tmp_path):
    day = 86_400_000_000
    rows = history.to_history(anomaly_rows(spark, 1704067200000000, 1704067200000000 - 40 * day, 1709251199999999))
    path = str(tmp_path / "h")
    history.write_history(rows, path)
    back = history.read_history(spark, path)
    assert sorted(str(r.day) for r in back.select("day").collect()) == ["2023-11-22", "2024-01-01", "2024-02-29"]
    assert history.history_query(back, prefix="10.1.2.0/24", since="2024-01-01", until="2024-02-01").count() == 1
    assert history.history_query(back, prefix="10.0.0.0/8", min_severity=1).count() == 3
    assert history.history_query(back, kind="path_leak").count() == 0
    assert history.history_query(back.withColumn("region", F.when(F.col("day") > "2024-01-31", "N1-S1").otherwise("N2")), region="N2").count() == 2
    manifest = history.day_manifest(back)
    now = F.lit("2024-03-01").cast("timestamp")
    assert [str(r.day) for r in history.prune_by_age(manifest, now, 61).collect()] == ["2023-11-22"]
    assert history.prune_by_age(manifest, F.lit("2024-01-31").cast("timestamp"), 30).count() == 1
    assert history.prune_by_size(manifest, 0).count() == 2
    assert history.prune_by_size(manifest, 1 << 40).count() == 0
    assert history.prune_outcome(manifest, now, 61, 0).first().days_dropped == 2
    assert history.drop_days(spark, path, history.prune_by_size(manifest, 0)) == 2
    assert history.read_history(spark, path).count() == 1


def test_snapshot_choice(spark):
    files = ["x/20240101.as-rel.txt.bz2", "x/20240201.as-rel2.txt.bz2", "x/20240301.as-rel2.v6-.txt.bz2", "x/2024.as-rel.txt.bz2"]
    rows = spark.createDataFrame([(f,) for f in files], "file string")
    assert relationships.latest_relationship_snapshot(rows).first().file == files[1]
    assert relationships.latest_relationship_snapshot(rows, dt.date(2024, 1, 15)).first().file == files[0]


def samples(spark, *rows):
    names = ["run_id", "elapsed_s", "rss_kb", "cpu_ticks", "sock_rx", "msgs", "dropped", "clients"]
    return spark.createDataFrame([("r", *r) for r in rows], ", ".join(f"{n} {'string' if n == 'run_id' else 'long'}" for n in names))


def test_run_report(spark):
    # Twelve seconds; the byte counter was reset in between.
    s = samples(spark, (3, 3072, 40, 7_000, 250, 3, 4), (9, 6144, 130, 600, 850, 5, 9), (15, 6144, 280, 1_200, 3_250, 9, 6))
    r = monitor.run_summary(s).first()
    assert (r.msgs_total, r.msgs_per_s, r.cpu_core_pct, r.rss_avg_mib, r.clients_peak) == (3_000, 250, 20, 5, 9)
    assert (r.reconnected, r.measured, r.bytes_per_msg) == (True, True, 0.4)
    said = ["t \x1b[33mWARN\x1b[0m slow disk", "t INFO 7 rows", "panicked at row 7", "", "t INFO feed subscribed to UPDATE stream", "t ERROR no route", "t INFO feed subscribed to UPDATE stream", "t DEBUG x"]
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate(said)], "run_id string, line_no long, value string")
    counts = monitor.log_summary(log).first()
    assert (counts.info, counts.warn, counts.error, counts.panics, counts.connections) == (3, 1, 1, 1, 2)
    assert [x.line for x in monitor.log_excerpt(log).filter("part = 'problem'").orderBy("place").collect()] == ["t WARN slow disk", "t ERROR no route"]
    none, calm = spark.createDataFrame([], "run_id string"), monitor.log_summary(log.filter("line_no = 1 or line_no = 4"))
    verdict = lambda summary, found, died: monitor.run_verdict(summary, found, died).first().verdict
    assert verdict(monitor.run_summary(s), monitor.log_summary(log.filter("line_no <> 2")), none) == "WARN"
    assert verdict(monitor.run_summary(s), monitor.log_summary(log), none) == "FAIL"
    assert verdict(monitor.run_summary(s), calm, none) == "PASS"
    assert verdict(monitor.run_summary(s), calm, spark.createDataFrame([("r",)], "run_id string")) == "FAIL"
    assert verdict(monitor.run_summary(samples(spark, (0, 1, 0, 0, 7, 0, 0), (4, 1, 0, 0, 707, 8, 0))), calm, none) == "WARN"
    assert verdict(monitor.run_summary(samples(spark, (0, 1, 0, 0, 7, 0, 0), (4, 1, 0, 0, 7, 0, 0))), calm, none) == "WARN"


def test_metrics_text(spark):
    text = ["# HELP x 3", "ns_messages_processed_total 1234", 'ns_anomalies_detected_total{kind="path_leak"} 7', "ns_graph_edges 1.2e3", "", "broken", "ns_graph_nodes x"]
    lines = spark.createDataFrame([("r", 0, i, x) for i, x in enumerate(text)], "run_id string, scrape_ts long, line_no long, value string")
    r = monitor_source.metrics_text_to_samples(lines).first()
    assert (r.msgs, r.leak, r.hijack, r.edges, r.nodes) == (1234, 7, 0, 1200, 0)


def test_history_batches_replay(spark, tmp_path):
    path = str(tmp_path / "s")
    write = streams.history_batches(path)
    write(anomaly_rows(spark, 1704067200000000), 0)
    write(anomaly_rows(spark, 1704067300000000, 1704067400000000), 1)
    write(anomaly_rows(spark, 1704067300000000, 1704067400000000), 1)
    assert history.read_history(spark, path).count() == 3


def _hijack_history(spark, n, days=3):
    return history.to_history(
        spark.range(n).selectExpr(
            f"1719792000000000 + (id % {days}) * 86400000000L + id as event_us", "'prefix_hijack' as kind", "cast(1 as smallint) as severity", "'x' as prefix",
            "1L as previous_origin", "2L as new_origin", "cast(null as bigint) as offending_asn", "cast(null as array<bigint>) as as_path", "cast(null as int) as updates_in_window", "cast(null as double) as threshold",
            "lpad(bin(xxhash64(id) & 16777215), 24, '0') as net_key", "cast(4 as tinyint) as family",
        )
    )


def _rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_prefix_lookups_read_few_rows_and_small_files_are_swapped(spark, tmp_path):
    path, rows = str(tmp_path / "h"), _hijack_history(spark, 240_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k in range(4):
            history.write_history(rows.filter(f"pmod(xxhash64(event_us), 4) = {k}"), path)
        before = day_files(tmp_path)
        lookup = lambda: history.history_query(history.read_history(spark, path), prefix="77.0.0.0/12")
        want = sorted(r.observed_at for r in lookup().collect())
        assert len(want) > 10
        assert history.compact_history(spark, path, "2024-07-03") == 2
        after = day_files(tmp_path)
        assert after["day=2024-07-03"] == before["day=2024-07-03"] >= 4
        assert all(after[d] < before[d] for d in ("day=2024-07-01", "day=2024-07-02"))
        assert sorted(r.observed_at for r in lookup().collect()) == want
        assert history.read_history(spark, path).count() == 240_000
        assert history.compact_history(spark, path, "2024-07-01") == 0
        history.compact_history(spark, path, "2024-07-04")
        assert _rows_scanned(lookup()) <= 240_000 / 4  # pages outside the prefix are skipped
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def day_files(tmp_path):
    return {d.name: len(list(d.rglob("part-*.parquet"))) for d in (tmp_path / "h").iterdir() if d.name.startswith("day=")}
