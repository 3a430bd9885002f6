import gzip
import json

import pytest
from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.operators import routes
from asnwatch.sources import updates as source


def frames(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "msg_id long, value string")


def message(**data):
    return {"type": "ris_message", "data": data}


# Two blocks of announcements, a set in the middle of the path, a quoted peer with blanks.
FULL = message(
    withdrawals=["10.77.128.0/17", "fd00:77::/48"], type="KEEPALIVE", origin="EGP", host="rrc21", peer="198.51.100.7", peer_asn=" 64777 ", timestamp=1719792000.000125,
    path=[64777, [3001, 3002], 3003], announcements=[{"next_hop": "198.51.100.7", "prefixes": ["10.1.2.0/24"]}, {"next_hop": "fe80::7", "prefixes": ["fd00:1:2::/47"]}],
)


def test_full_update(spark):
    row = source.split_frames(frames(spark, FULL))[0].first()
    assert row.path == [64777, 3001, 3002, 3003]
    assert (row.event_us, row.peer_asn, row.msg_type, row.origin_attr) == (1719792000000125, 64777, "KEEPALIVE", "EGP")
    ops = routes.route_ops(source.split_frames(frames(spark, FULL))[0]).orderBy("pos").collect()
    assert [(r.op, r.prefix, r.origin_asn) for r in ops] == [("A", "10.1.2.0/24", 3003), ("A", "fd00:1:2::/47", 3003), ("W", "10.77.128.0/17", None), ("W", "fd00:77::/48", None)]
    assert [r.family for r in ops] == [4, 6, 4, 6]


OUTCOMES = [
    (message(), "routing"),
    (message(peer_asn=3010), "routing"),
    (message(path=[3011, [3012, 3013], []]), "routing"),
    (message(announcements=[{"next_hop": "y", "prefixes": []}], withdrawals=[]), "routing"),
    (message(peer_asn=-5), "quarantine"),
    (message(peer_asn="AS3010"), "quarantine"),
    (message(path=[3010, "x"]), "quarantine"),
    (message(path=[7.25]), "quarantine"),
    (message(path=[4294967296]), "quarantine"),
    (message(announcements=[{"next_hop": "y", "prefixes": ["10.8.0.0/16", "10.300.0.0/16"]}]), "quarantine"),
    (message(withdrawals=["fd00::/129"]), "quarantine"),
    ("[]", "quarantine"),
    ("", "quarantine"),
    (json.dumps(message(path=[3010]))[:-4], "quarantine"),
    ({"data": {"host": "rrc21"}}, "quarantine"),
    ({"type": "ris_rrc_list", "data": None}, "control"),
    ({"type": "ris_subscribe_ok"}, "control"),
]


def test_outcomes(spark):
    raw = frames(spark, *[frame for frame, _ in OUTCOMES])
    assert [r.outcome for r in source.parse_frames(raw).orderBy("msg_id").collect()] == [outcome for _, outcome in OUTCOMES]
    rows = {r.msg_id: r for r in source.split_frames(raw)[0].collect()}
    assert (rows[0].path, rows[0].announcements, rows[0].withdrawals, rows[0].peer_asn, rows[0].msg_type) == ([], [], [], None, "OTHER")
    assert (rows[1].peer_asn, rows[2].path) == (3010, [3011, 3012, 3013])
    counts = {r.outcome: r.n_frames for r in source.frame_counts(raw).collect()}
    assert counts == {o: sum(x == o for _, x in OUTCOMES) for o in ("routing", "control", "quarantine")}


def test_frames_are_parsed_once(spark):
    plan = source.split_frames(frames(spark, FULL))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@pytest.mark.parametrize(
    ("text", "family", "length", "start"),
    [
        ("10.1.2.0/24", 4, 24, "000010100000000100000010"),
        ("10.1.2.129/25", 4, 25, "0000101000000001000000101"),
        ("0.0.0.0/0", 4, 0, ""),
        ("2001:db8::/32", 6, 32, "00100000000000010000110110111000"),
        ("::/0", 6, 0, ""),
        ("::1/128", 6, 128, "0" * 127 + "1"),
        ("1:2:3:4:5:6:7:8/16", 6, 16, "0000000000000001"),
        ("::ffff:10.0.0.1/128", 6, 128, "0" * 80 + "1" * 16 + "00001010000000000000000000000001"),
        ("10.0.0.0/33", None, None, None),
        ("10.0.0/8", None, None, None),
        ("10.0.0.256/8", None, None, None),
        ("010.0.0.0/8", None, None, None),
        ("1::2::3/64", None, None, None),
        ("1:2:3:4:5:6:7/64", None, None, None),
        ("12345::/16", None, None, None),
        ("2001:db8::/129", None, None, None),
        ("garbage", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_prefixes(spark, text, family, length, start):
    row = normalise_prefixes(spark.createDataFrame([(text,)], "prefix string")).first()
    assert (row.family, row.prefix_len, row.net_key) == (family, length, start)


def test_filters(spark):
    both = message(host="rrc21", path=[64777, [3001, 3002], 3003], announcements=[{"next_hop": "y", "prefixes": ["10.1.2.0/24", "2001:db8::/32"]}])
    rows = source.split_frames(frames(spark, both, message(type="UPDATE", host="rrc01", path=[7], withdrawals=["10.1.0.0/16"])))[0]
    ids = lambda df: sorted(r.msg_id for r in df.collect())
    assert ids(routes.filter_collector(rows, "rrc01")) == [1]
    assert ids(routes.filter_path_asn(rows, 3002)) == [0]
    assert ids(routes.filter_prefix(rows, None, more_specific=True)) == [0, 1]
    assert ids(routes.filter_prefix(rows, "10.1.0.0/16")) == [1]
    assert ids(routes.filter_prefix(rows, "10.1.0.0/16", more_specific=True)) == [0, 1]
    assert ids(routes.filter_prefix(rows, "10.1.2.0/24", less_specific=True)) == [0, 1]
    assert ids(routes.filter_prefix(rows, "2001:db8::/32")) == [0]
    with pytest.raises(ValueError):
        routes.filter_prefix(rows, "10.1.0.0/40")


def test_event_time_falls_back(spark):
    raw = frames(spark, message(type="UPDATE"))
    assert source.split_frames(raw, fallback_us=F.lit(77))[0].first().event_us == 77


def _written(path, files):
    for name, values in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        opened = gzip.open if name.endswith(".gz") else open
        with opened(path / name, "wt") as f:
            f.writelines(json.dumps(v) + "\n" if v else "\n" for v in values)


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_ids_are_file_and_line(spark, tmp_path, split):
    at = lambda k: message(timestamp=1_719_792_000 + k, peer="x" * (k % 9 * 10))
    files = {"000.txt": [at(0)], "001.txt": [at(k) for k in range(1, 40)], "002.txt": [], "003.txt.gz": [at(50), None, "pong", at(50), at(50)], "day2/000.txt": [at(60)] * 30}
    _written(tmp_path, files)
    names = sorted(files, key=lambda n: (n.rpartition("/")[0], n))
    names.remove("002.txt")  # a file without lines has no number
    want = sorted((names.index(n) << source.LINE_BITS | i, int(v["data"]["timestamp"]) * 1_000_000) for n in names for i, v in enumerate(files[n]) if isinstance(v, dict))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = source.read_updates(spark, f"{tmp_path}/*.txt*,{tmp_path}/day2".split(",")).select("msg_id", "event_us").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == want


def test_stream_gives_the_ids_of_batch(spark, tmp_path):
    repeated = [message(timestamp=1_719_792_000, peer="same")] * 3
    path, seen = str(tmp_path), {}
    sink = source.update_batches(f"{path}/updates")
    run = source.numbered_batches(lambda df, n: (sink(df, n), seen.setdefault(n, df.count())), f"{path}/numbers")
    for name, values in {"b.txt": repeated, "a.txt": [message(timestamp=1_719_792_007), *repeated]}.items():
        _written(tmp_path / "in", {name: values})
        query = source.stream_frames(spark, f"{path}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{path}/updates").select("msg_id", "event_us")
    ids = sorted(r.msg_id for r in stored.collect())
    assert ids == [0, 1, 2, *[1 << source.LINE_BITS | k for k in range(4)]]  # b.txt came first
    by_arrival = source.read_updates(spark, f"{path}/in", files=source.file_numbers(spark, f"{path}/numbers")).select("msg_id", "event_us")
    assert sorted(map(tuple, by_arrival.collect())) == sorted(map(tuple, stored.collect()))
    followed = source.stream_updates(spark, f"{path}/updates").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state2")
    followed.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.msg_id for r in spark.read.parquet(f"{path}/out").collect()) == ids
    run(source.file_lines(spark.read.text(f"{path}/in/a.txt")), 1)  # a replay
    assert sorted(r.msg_id for r in spark.read.parquet(f"{path}/updates").collect()) == ids
