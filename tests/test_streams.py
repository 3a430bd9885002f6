"""The streaming twins over the smallest tables give what the batch operators give."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from asnwatch.operators import detect, feed, origins, topology
from asnwatch.sources import blocks
from asnwatch.streaming import repair, streams

DATA = "/root/testdata/sf0.001"
PAIRS = {
    "stream_hijacks": ("origin_hijacks", ["prefix", "previous_origin", "new_origin", "severity"]),
    "stream_leaks": ("reported_leaks", ["msg_id", "event_us", "offending_asn", "severity"]),
    "stream_churn": ("route_churn", ["msg_id", "prefix", "peer_asn", "n_updates", "threshold", "severity"]),
    "stream_edges": ("link_changes", ["a", "b", "event_us"]),
}


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", PAIRS)
def test_stream_equals_batch(spark, name):
    twin, columns = PAIRS[name]
    queries = __spark_entry__.queries()
    rows = lambda q: sorted(map(tuple, queries[q](spark, DATA).select(columns).collect()))
    got = rows(name)
    assert got
    assert got == rows(twin)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_churn_over_batches_equals_batch(spark, tmp_path):
    """Files in time order, one a micro-batch; other vantages fill the ring while an episode goes on."""
    rows = []
    for second in range(36):
        # Two vantages that announce much, in every third file only, and many quiet ones between.
        busy = [f"busy{k}" for k in range(2) for _ in range(6)] if second // 3 % 3 == 0 else []
        rows += [(p, 1, second) for p in busy] + [(f"quiet{i}", 2, second) for i in range(12)]
    schema = "msg_id long, event_us long, pos int, prefix string, peer_asn long, family byte, net_key string, op string"
    begin = 1_719_792_000_000_000  # in batch 0 the watermark is the epoch
    rows = [(i, begin + second * 1_000_000, 0, prefix, peer, 4, prefix, "A") for i, (prefix, peer, second) in enumerate(rows)]
    path, window, options = str(tmp_path), 10_000_000, {"min_updates": 13, "floor": 13.0, "baseline": 40, "deviations": 2.0}
    for k in range(12):
        part = [r for r in rows if (r[1] - begin) // 3_000_000 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    ops = spark.createDataFrame(rows, schema)
    timed = lambda df: df.withColumn("event_ts", F.timestamp_micros("event_us")).withWatermark("event_ts", "0 seconds")
    streams.use_state_store(spark)
    counts = detect.vantage_counts(ops, window)
    want = detect.detect_churn(detect.churn_threshold(counts, **options), options["min_updates"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sink = lambda df, number: df.write.parquet(f"{path}/out/batch={number}")
    job = streams.stream_churn_counts(timed(stream), window).writeStream.foreachBatch(streams.churn_batches(sink, f"{path}/ring", **options))
    job.option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("msg_id long, n_updates int, threshold double, severity short, batch int").parquet(f"{path}/out")
    columns = ["msg_id", "n_updates", "threshold", "severity"]
    assert len(list((tmp_path / "out").iterdir())) >= 12  # and one without rows, which drops state
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []


def test_quiet_vantages_leave_no_state(spark, tmp_path):
    path, schema = str(tmp_path), "msg_id long, event_us long, pos int, prefix string, peer_asn long, op string"
    for k in range(4):  # other vantages in each file, a minute apart
        rows = [(k * 100 + i, (28_663_200 + k) * 60_000_000 + i * 1_000, 0, f"p{k}-{i % 20}", 1, "A") for i in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withColumn("event_ts", F.timestamp_micros("event_us")).withWatermark("event_ts", "0 seconds")
    streams.use_state_store(spark)
    writer = streams.stream_churn_counts(stream, 10_000_000).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    job = writer.trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 240
    assert sorted({r.n_updates for r in spark.read.parquet(f"{path}/out").collect()}) == [1, 2, 3]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress]
    assert rows[0] == rows[-1] == min(rows)  # those of 20 vantages, of 80 seen


def _stream(spark, path, rows, schema, files):
    """A stream over ``rows`` (times first), dealt out to files by order, with a watermark."""
    streams.use_state_store(spark)
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return stream.withColumn("event_ts", F.timestamp_micros("event_us")).withWatermark("event_ts", "0 seconds")


def _finish(stream, path):
    job = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return job, stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_hijacks_over_batches_equal_batch(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for i in range(400):  # one network that meets many origins, one that is withdrawn often, one with few
        net = rng.choice(["0001", "0010", "0011"])
        gone = rng.random() < {"0001": 0.0, "0010": 0.2, "0011": 0.03}[net]
        origin = None if gone or rng.random() < 0.05 else rng.randrange(30 if net == "0001" else 4)
        rows.append((1_719_792_000_000_000 + i // 3 * 1_000_000, i, i % 2, "W" if gone else "A", net, 4, net, origin))
    schema = "event_us long, msg_id long, pos int, op string, prefix string, family byte, net_key string, origin_asn long"
    _, got = _finish(streams.stream_hijacks(_stream(spark, str(tmp_path), rows, schema, 5)), str(tmp_path))
    ops = spark.createDataFrame(rows, schema).withColumns({"prefix_len": F.lit(4), "peer_asn": F.lit(1).cast("long")})
    columns = ["msg_id", "net_key", "previous_origin", "new_origin", "distinct_origins", "severity"]
    want = detect.detect_hijacks(origins.origin_observations(ops)).select(columns).collect()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want))
    assert {r.distinct_origins for r in want} == set(range(2, 17))


def test_repeated_frames_leak_one_by_one(spark, tmp_path):
    begin = 1_719_792_000_000_000
    at = [0, 0, 5, 30, 200, 259, 320, 900, 900]  # seconds; the first two and the last two are alike but for their number
    rows = [(begin + s * 1_000_000, i, [1, 2, 3]) for i, s in enumerate(at)] + [(begin + 901_000_000, 99, [7, 8, 9])]
    relationships = spark.createDataFrame([(1, 2, "provider"), (3, 2, "provider")], "a long, b long, rel string")
    stream = _stream(spark, str(tmp_path), rows, "event_us long, msg_id long, path array<long>", 5)
    job, got = _finish(streams.stream_leaks(stream, relationships), str(tmp_path))
    assert sorted((r.msg_id, r.offending_asn, r.violations, r.severity) for r in got.collect()) == [(i, 2, 1, 1) for i in (0, 4, 6, 7)]


def test_quiet_offenders_leave_no_state(spark, tmp_path):
    begin = 1_719_792_000_000_000
    rows = [(begin + i * 10_000_000, i, [1, 100 + i, 3]) for i in range(50)]
    relationships = spark.createDataFrame([(x, 100 + i, "provider") for i in range(50) for x in (1, 3)], "a long, b long, rel string")
    stream = _stream(spark, str(tmp_path), rows, "event_us long, msg_id long, path array<long>", 5)
    job, got = _finish(streams.stream_leaks(stream, relationships), str(tmp_path))
    assert got.count() == 50
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in job.recentProgress]
    assert kept[-1] < 30  # of the last minute's offenders alone


def test_late_rows_are_set_aside_alike_in_a_replay(spark, tmp_path):
    path, kept = str(tmp_path), {}
    run = streams.late_batches(lambda df, number: kept.update({number: sorted(r.event_us for r in df.collect())}), path, 10)
    batches = [[100, 95], [120, 89, 91], [109, 110, 200], [180]]
    for number, times in [*enumerate(batches), (2, batches[2]), (3, batches[3])]:
        run(spark.createDataFrame([(x,) for x in times], "event_us long"), number)
    assert kept == {0: [95, 100], 1: [91, 120], 2: [110, 200], 3: []}
    assert sorted((r.batch, r.event_us) for r in streams.late_rows(spark, path, "event_us long, batch int").collect()) == [(1, 89), (2, 109), (3, 180)]


def test_subscribers_fold_snapshot_and_feed(spark, tmp_path):
    path = str(tmp_path)
    write = streams.feed_batches(path)
    frames = lambda *rows: spark.createDataFrame([(k, a, b, us, None, None) for us, k, a, b in rows], "kind string, a long, b long, event_us long, region string, severity float")
    write(frames((1, "LinkUp", 1, 2), (2, "LinkUp", 3, 2)), 0)
    write(frames((9, "LinkDown", 1, 2), (4, "LinkUp", 5, 6)), 1)
    write(frames((9, "LinkDown", 1, 2), (4, "LinkUp", 5, 6)), 1)  # a replay
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2)], "lo long, hi long, last_seen_us long")
    got = [(r.batch, r.value) for r in streams.subscription(spark, path, edges, after_batch=0).orderBy("batch").collect()]
    up, down = '{"kind":"LinkUp","a":%d,"b":%d}', '{"kind":"LinkDown","a":%d,"b":%d}'
    assert sorted(got[:2]) == [(0, up % (1, 2)), (0, up % (2, 3))]
    assert got[2:] == [(1, up % (5, 6)), (1, down % (1, 2))]


def test_batches_are_counted_as_they_are_read(spark, tmp_path):
    path = str(tmp_path)
    run = streams.counted_batches(lambda df, number: df.write.format("noop").mode("overwrite").save(), path)
    for number, times in enumerate([[5, 3], [], [9]]):
        run(spark.createDataFrame([(x,) for x in times], "event_us long"), number)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).orderBy("batch").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 3, 5), (1, 0, None, None), (2, 1, 9, 9)]


def test_late_rows_repair_what_they_touch(spark):
    rng, begin = random.Random(13), 1_719_792_000_000_000
    schema = "event_us long, msg_id long, pos int, hop int, op string, prefix string, family byte, net_key string, peer_asn long, a long, b long"
    rows = []
    for i in range(900):
        us = begin + i * 1_000_000 + rng.randrange(3) * 200_000
        busy = i // 60 % 3 == 1 and rng.random() < 0.6
        prefix = "busy" if busy else f"q{rng.randrange(40)}"
        rows.append((us, i, 0, 0, "W" if rng.random() < 0.03 else "A", prefix, 4, prefix, 1, rng.randrange(9), 9 + rng.randrange(3)))
    late = [r for r in rows if 200 < r[1] < 860 and (r[1] % 23 == 5 or 60 <= r[1] % 180 < 72)]
    every, behind = spark.createDataFrame(rows, schema), spark.createDataFrame(late, schema)
    on_time = every.join(behind.select("msg_id"), "msg_id", "left_anti").select(every.columns)
    window, options = 20_000_000, {"min_updates": 4, "floor": 4.0, "baseline": 60, "deviations": 2.0}
    columns = ["msg_id", "event_us", "pos", "prefix", "peer_asn", "n_updates", "threshold"]
    judge = lambda ops: detect.churn_threshold(detect.vantage_counts(ops, window), **options).select(columns)
    fired = lambda ops: detect.detect_churn(judge(ops), 4).select(*columns, "severity")
    got = repair.repair_churn(judge(on_time), fired(on_time), every, behind, window, **options)
    want, before = (sorted(map(tuple, fired(x).collect())) for x in (every, on_time))
    assert sorted(map(tuple, got.collect())) == want != before
    assert repair.repair_churn(judge(on_time), fired(on_time), every, behind.filter("false"), window, **options).count() == len(before)

    end = begin + 900_000_000
    observed = lambda df: topology.canonical_edge(df.select("msg_id", "event_us", "hop", "a", "b"))
    ttl, sweep = 30_000_000, 10_000_000

    def changes(df):
        episodes = topology.edge_episodes(observed(df), ttl, sweep, end)
        up = topology.link_up(episodes).select(F.lit("LinkUp").alias("kind"), "a", "b", "event_us")
        return up.union(topology.link_down(episodes).select(F.lit("LinkDown"), "a", "b", "event_us"))

    got = repair.repair_edges(changes(on_time), observed(every), observed(behind), end, ttl, sweep)
    want, before = (sorted(map(tuple, changes(x).collect())) for x in (every, on_time))
    assert sorted(map(tuple, got.collect())) == want != before


def test_subscribers_meet_the_feed_at_a_batch(spark, tmp_path):
    path = str(tmp_path)
    regions = blocks.geo_blocks(spark.createDataFrame([("10.0.0.0/8", "AA", None)], "network string, country string, subdivision string"))
    run = streams.whole_feed_batches(path, regions, versions=2, min_updates=2, floor=2.0)
    columns = "part string, kind string, a long, b long, event_us long, msg_id long, stage int, pos int, prefix string, family byte, net_key string, previous_origin long, new_origin long, severity short, peer_asn long, n_updates int"
    link = lambda kind, a, b, us: ("link", kind, a, b, us, us, 0 if kind == "LinkUp" else 9, 0, *[None] * 8)
    hijack = lambda us: ("hijack", None, None, None, us, us, None, 0, "10.1.0.0/16", 4, "0000101000000001", 1, 2, 2, None, None)
    count = lambda us, n: ("count", None, None, None, us, us, None, 0, "10.2.0.0/16", None, None, None, None, None, 7, n)
    batches = [[link("LinkUp", 1, 2, 1), link("LinkUp", 4, 3, 2), hijack(3)], [link("LinkDown", 1, 2, 9), link("LinkUp", 5, 6, 8), count(10, 1), count(11, 3)], [link("LinkUp", 2, 1, 20)], []]
    for number, rows in enumerate(batches):
        for _ in range(2):  # each batch once more
            run(spark.createDataFrame(rows, columns), number)
    up, down, area = '{"kind":"LinkUp","a":%d,"b":%d}', '{"kind":"LinkDown","a":%d,"b":%d}', '{"kind":"AreaDegraded","region":"AA","severity":%s}'
    order = ["batch", *feed.ORDER]
    frames = [(r.batch, r.value) for r in streams.feed_frames(spark, path).orderBy(order).collect()]
    assert frames == [(0, up % (1, 2)), (0, up % (4, 3)), (0, area % "1.0"), (1, up % (5, 6)), (1, down % (1, 2)), (1, area % "0.66"), (2, up % (2, 1))]
    read = [r.value for r in streams.subscription_at(spark, path, 2).orderBy(order).collect()]
    assert sorted(read) == sorted([up % (3, 4), up % (5, 6), up % (1, 2)])
    assert sorted(p.name for p in (tmp_path / "live").iterdir() if p.is_dir()) == ["2", "3"]
