"""What must not grow faster than the input: broadcast sides, work a row, work a key, memory of a task."""

import io
from contextlib import redirect_stdout

from asnwatch.operators import detect, origins, spread, topology
from asnwatch.plans import queries as q
from asnwatch.plans import tables as t
from asnwatch.sources import updates

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_sides_that_grow_are_not_broadcast_on_an_estimate(spark):
    """Tiny tables, so that every estimate is below the limit of broadcasts, as that of decoded frames is at any size."""
    messages = updates.split_frames(t.frames(spark, SF))[0]
    ops = q._ops(spark, SF, messages)
    relationships = q._relationships(spark, SF)
    most, detect.BROADCAST_ROWS = detect.BROADCAST_ROWS, 0
    try:
        apexes = detect.valley_apexes(messages, relationships)
    finally:
        detect.BROADCAST_ROWS = most
    joins = [
        topology.edge_episodes(topology.path_edges(messages), q.TTL, q.SWEEP, 0, q.D),
        detect.vantage_counts(ops, 3 * q.D, q.D),
        detect.with_global_index(ops),
        origins.apply_withdrawals(ops, q.D),
        origins.origin_observations(ops, spread_us=q.D),
        spread.lagged(ops, ["prefix"], ["event_us", "msg_id"], _last=ops.event_us),
        apexes,
    ]
    for df in joins:
        assert "Broadcast" not in plan(df)


def test_counts_of_a_window_cost_the_same_whatever_it_holds(spark):
    """A sliding range frame counts its rows anew for each row; a running sum does not. Thresholds do not carry a block of
    counts beside each of them."""
    ops = q._ops(spark, SF)
    counts = detect.vantage_counts(ops, 3 * q.D, q.D)
    assert "RangeFrame" not in plan(counts)
    judged = plan(detect.churn_threshold(counts, **q.CHURN))
    assert "ArrowEvalPython" in judged and "posexplode(own" not in judged


def test_dense_vantage_is_counted_and_judged(spark):
    """2,500 announcements of one vantage, twelve at a time: more than two blocks, against plain Python."""
    from statistics import median

    n, window = 2500, 900
    rows = spark.range(n).selectExpr("id as msg_id", "id div 12 * 10 as event_us", "0 as pos", "'A' as op", "'10.0.0.0/8' as prefix", "4 as family", "'00001010' as net_key", "64500L as peer_asn")
    counts = detect.vantage_counts(rows, window, 70)
    got = sorted(detect.churn_threshold(counts, 3, 2.0, 3.0, bucket_us=1000).collect(), key=lambda r: r.msg_id)
    times = [k // 12 * 10 for k in range(n)]
    want = [sum(1 for j in range(max(0, k - 1200), k + 1) if times[j] >= times[k] - window) for k in range(n)]
    assert [(r.nth, r.n_updates) for r in got] == [(k + 1, w) for k, w in enumerate(want)]
    for k, r in enumerate(got):
        last = want[max(0, k - 1023) : k + 1]
        middle = median(last)
        level = max(middle + 2 * detect.MAD_SCALE * median(abs(x - middle) for x in last), 3.0) if len(last) >= 32 else 3.0
        assert r.threshold == (level if r.n_updates >= 3 else None)


class _Handle:
    """The part of a state store's handle that a processor of one key uses."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


def test_a_shard_of_links_follows_the_rule_of_each():
    """Many edges in one key of the stream, over batches with late rows, against each edge on its own."""
    import random

    import pandas as pd

    from asnwatch.operators import feed
    from asnwatch.streaming import streams

    rng, ttl, sweep = random.Random(5), 20_000, 10_000
    handle = _Handle()
    links = streams._Links(ttl, sweep)
    links.init(handle)
    clock = type("Clock", (), {"ms": 0, "getCurrentWatermarkInMs": lambda self: self.ms})()
    got, want, last, newest, number = [], [], {}, 0, 0
    down_at = lambda us: ((us + ttl) // sweep + 1) * sweep
    columns = ["lo", "hi", "a", "b", "event_us", "msg_id", "hop"]
    for batch in range(8):
        rows = []
        for _ in range(60):
            lo, hi = rng.randrange(12), rng.randrange(12, 15)
            a, b = rng.choice([(lo, hi), (hi, lo)])
            rows.append((lo, hi, a, b, batch * 25_000 + rng.randrange(30_000), number, rng.randrange(3)))
            number += 1
        for out in links.handleInputRows((0,), iter([pd.DataFrame(rows[:30], columns=columns), pd.DataFrame(rows[30:], columns=columns)]), clock):
            got += out.itertuples(index=False, name=None)
        for lo, hi, a, b, us, msg, hop in sorted(rows, key=lambda r: (r[4], r[5], r[6])):
            before = last.get((lo, hi))
            if before is None or us > down_at(before):
                if before is not None:
                    want.append((feed.LINK_DOWN, lo, hi, down_at(before), feed.SWEEP, 9, 0))
                want.append((feed.LINK_UP, a, b, us, msg, 0, hop))
            last[lo, hi] = us if before is None else max(before, us)
        for at in [t for t in handle.timers if t <= clock.ms]:
            handle.timers.discard(at)
            for out in links.handleExpiredTimer((0,), clock, None):
                got += out.itertuples(index=False, name=None)
        for (lo, hi), us in list(last.items()):
            if down_at(us) // 1000 < clock.ms:
                want.append((feed.LINK_DOWN, lo, hi, down_at(us), feed.SWEEP, 9, 0))
                del last[lo, hi]
        newest = max(newest, *(r[4] for r in rows))
        clock.ms = newest // 1000
        assert sorted(got) == sorted(want)
        assert (len(links._known()[0]), len(handle.timers)) == (len(last), min(len(last), 1))


def test_subscribers_to_all_links_need_no_top_k(spark):
    edges = spark.createDataFrame([(1, 2, 1, 2, 5, 7)], "lo long, hi long, a long, b long, up_us long, last_seen_us long")
    assert "TakeOrdered" not in plan(topology.snapshot_edges(edges, None)) and topology.snapshot_edges(edges, None).count() == 1


def test_a_file_of_frames_is_made_after_its_rows_are_sorted(spark, monkeypatch, tmp_path):
    """What one task sorts is the fields of events, not their frames."""
    seen = []
    rows = t.frame_rows
    monkeypatch.setattr(t, "frame_rows", lambda events: seen.append(rows(events)) or seen[-1])
    q._write_frames(spark, SF, str(tmp_path), 1)
    text = plan(seen[0])
    above, below = text.split("Sort [event_id")
    assert "ris_message" in above and "ris_message" not in below
    want = [r.value for r in t.frames(spark, SF).filter("msg_id % 4 = 1").orderBy("msg_id").collect()]
    assert [r.value for r in spark.read.text(f"{tmp_path}/file=1").collect()] == want


def test_relationship_lines_are_parsed_after_repeats_are_gone(spark):
    """The optimiser must not copy the parsing of a line into a filter below what makes lines distinct."""
    text = plan(q._relationships(spark, SF))
    above, below = text.rsplit("HashAggregate(keys=[a", 1)
    assert "RLIKE" in above and "RLIKE" not in below


def test_both_directions_of_relationships_are_worked_out_once(spark):
    """They are counted for the choice of the join, and joined for either neighbour."""
    apexes = plan(detect.valley_apexes(t.updates(spark, SF), q._relationships(spark, SF)))
    assert "Window" not in apexes


def test_episodes_meet_by_spans_not_by_rows(spark):
    """Rows of an edge are aggregated where they are read; no window runs over them and nothing is joined back to them."""
    text = plan(topology.edge_episodes(topology.path_edges(t.updates(spark, SF)), q.TTL, q.SWEEP, 0, q.D))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2
    assert "Window" not in text.split("Exchange hashpartitioning")[-1]


def test_spans_of_an_edge_are_no_longer_than_its_life(spark):
    """With a time to live of 0 each moment is an episode of its own."""
    rows = spark.createDataFrame([(us, n, 0, 1, 2, 1, 2) for n, us in enumerate([1, 28, 28, 32, 59, 120])], "event_us long, msg_id long, hop int, a long, b long, lo long, hi long")
    times = lambda *options: sorted((r.up_us, r.up_msg_id, r.last_seen_us, r.down_us) for r in topology.edge_episodes(rows, *options).collect())
    assert times(10, 5) == [(1, 0, 1, 15), (28, 1, 32, 45), (59, 4, 59, 70), (120, 5, 120, None)]
    assert times(0, 1) == [(1, 0, 1, 2), (28, 1, 28, 29), (32, 3, 32, 33), (59, 4, 59, 60), (120, 5, 120, None)]


def test_anomalies_are_worked_out_once(spark, monkeypatch):
    """Regions, ranges of the history and counters read them more than once; the counters share them with the feed."""
    assert "Exchange" not in plan(q._anomalies(spark, SF))
    calls, found = [], q._anomalies(spark, SF)
    monkeypatch.setattr(q, "_anomalies", lambda *args: calls.append(args) or found)
    assert q.pipeline_counters(spark, SF).count() and len(calls) == 1


def test_readers_of_links_need_no_anomalies(spark, monkeypatch):
    monkeypatch.setattr(q, "_anomalies", None)
    links = q.current_links(spark, SF)
    assert links.count() == q._live(spark, SF).count() > 0
    assert q.current_nodes(spark, SF).count() == topology.degree(q._live(spark, SF)).count()


def test_sights_of_origins_are_aggregated_once(spark):
    """The windows over them, and what each bucket opens with, share one shuffle by segment."""
    text = plan(origins.origin_observations(spread.stored(q._ops(spark, SF)), spread_us=q.D))
    assert text.count("Exchange") <= 5


def test_thresholds_from_a_sorted_list_are_those_of_sorted_windows():
    """Odd and even windows, ties, windows not yet full, against medians of each window."""
    import random
    from statistics import median

    import pandas as pd

    rng = random.Random(7)
    for baseline, most, before, own in [(1, 5, 1, 1), (2, 9, 2, 2), (7, 4, 7, 7), (8, 1 << 40, 8, 5), (64, 30, 64, 64), (64, 1000, 0, 64)]:
        every = [rng.randrange(most) for _ in range(before + own)]
        got = detect._levels(2, 2.0, 1.0, baseline, 1)(pd.Series([every[:before]]), pd.Series([every[before:]]))[0]
        for k in range(own):
            last = every[max(0, before + k + 1 - baseline) : before + k + 1]
            middle = median(last)
            level = max(middle + 2 * detect.MAD_SCALE * median(abs(x - middle) for x in last), 1.0)
            assert every[before + k] < 2 or abs(got[k] - level) <= 1e-9 * level
