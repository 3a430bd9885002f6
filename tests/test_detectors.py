import random

import pytest
from pyspark.sql import functions as F

from asnwatch.functions.prefixes import normalise_prefixes
from asnwatch.operators import detect, origins, topology
from asnwatch.sources.relationships import parse_as_relationships, with_both_directions
from tests import interpreter


def ops_of(spark, rows):
    """rows: (seq, op, prefix, origin)."""
    df = spark.createDataFrame([(s, s * 10, 0, op, p, 64500, o) for s, op, p, o in rows], "msg_id long, event_us long, pos int, op string, prefix string, peer_asn long, origin_asn long")
    return normalise_prefixes(df)


def observed(spark, rows, **options):
    got = origins.origin_observations(ops_of(spark, rows), **options).orderBy("msg_id").collect()
    return [(r.msg_id, r.previous_origin, r.new_origin, r.changed, r.distinct_origins) for r in got]


def test_origin_scenarios(spark):
    p = "10.0.0.0/24"
    rows = [(0, "A", p, 1), (1, "A", p, 1), (2, "A", p, 2), (3, "A", p, 1), (4, "A", p, 3), (5, "W", p, None), (6, "A", p, 9), (7, "A", "2001:db8::/32", 9), (8, "A", p, None)]
    assert observed(spark, rows) == [(0, None, 1, False, 1), (1, 1, 1, False, 1), (2, 1, 2, True, 2), (3, 2, 1, False, 2), (4, 1, 3, True, 3), (6, None, 9, False, 1), (7, None, 9, False, 1)]


def test_saturated_origins_flag_each_time(spark):
    rows = [(i, "A", "10.0.0.0/24", i % 18) for i in range(40)]
    got = observed(spark, rows)
    assert max(r[4] for r in got) == 16
    assert [r[0] for r in got if r[3]] == [*range(1, 18), 34, 35]
    assert [r[0] for r in observed(spark, rows, suppress_saturated=True) if r[3]] == [*range(1, 18)]


@pytest.mark.parametrize("seed", range(3))
def test_origins_against_single_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "W" if rng.random() < 0.05 else "A", f"10.{rng.randrange(3)}.0.0/16", rng.choice([None, *range(25)])) for i in range(600)]
    rows = [(s, op, p, None if op == "W" else o) for s, op, p, o in rows]
    assert observed(spark, rows) == list(interpreter.origins(rows))
    assert observed(spark, rows, spread_us=370) == list(interpreter.origins(rows))
    assert observed(spark, rows, spread_us=None) == list(interpreter.origins(rows))
    segments = lambda **options: sorted((r.msg_id, r.segment) for r in origins.apply_withdrawals(ops_of(spark, rows), **options).collect())
    assert segments(spread_us=370) == segments(spread_us=None)
    table = {r.net_key: (r.origin, r.origins) for r in origins.prefix_origins(ops_of(spark, rows)).collect()}
    want = {}
    for s, op, p, o in rows:
        if op == "W":
            want.pop(p, None)
        elif o is not None:
            seen = want.get(p, (None, []))[1]
            want[p] = (o, seen if o in seen or len(seen) > 15 else [*seen, o])
    assert sorted(table.values()) == sorted(want.values())


def paths_of(spark, rows):
    return spark.createDataFrame([(i, us, path) for i, (us, path) in enumerate(rows)], "msg_id long, event_us long, path array<long>")


def test_prepends_and_loops(spark):
    rows = topology.path_edges(paths_of(spark, [(1, [1, 1, 2, 3, 3]), (2, [5, 5]), (3, []), (4, [7])])).collect()
    assert [(r.a, r.b) for r in rows] == [(1, 2), (2, 3)]


@pytest.mark.parametrize("seed", range(2))
def test_edges_against_single_pass(spark, seed):
    rng = random.Random(seed)
    us, rows = 0, []
    for _ in range(300):
        us += rng.choice([0, 1, 5, 10, 40])
        rows.append((us, [rng.randrange(6) for _ in range(rng.randrange(5))]))
    for spread_us in (7, 100, 1 << 40):
        episodes = topology.edge_episodes(topology.path_edges(paths_of(spark, rows)), ttl_us=30, sweep_us=10, as_of_us=us, spread_us=spread_us)
        got = [("up", r.a, r.b, r.event_us) for r in topology.link_up(episodes).collect()] + [("down", r.a, r.b, r.event_us) for r in topology.link_down(episodes).collect()]
        assert sorted(got) == sorted(interpreter.edges(rows, 30, 10))


def test_graph_tables(spark):
    edges = topology.canonical_edge(spark.createDataFrame([(1, 2, 10), (3, 2, 20), (2, 4, 30)], "a long, b long, last_seen_us long"))
    assert {r.asn: r.peers for r in topology.peers(edges).collect()} == {1: [2], 2: [1, 3, 4], 3: [2], 4: [2]}
    asked = spark.createDataFrame([(2,), (9,)], "asn long")
    assert {r.asn: r.degree for r in topology.degree(edges, asked).collect()} == {2: 3, 9: 0}
    assert tuple(topology.graph_counts(edges).first()) == (4, 3)
    left, gone = topology.remove_edges(edges, spark.createDataFrame([(2, 1), (8, 9)], "a long, b long"))
    assert (left.count(), gone.count()) == (2, 1)
    assert [(r.lo, r.hi) for r in topology.snapshot_edges(edges, 2).collect()] == [(2, 4), (2, 3)]
    assert tuple(topology.graph_counts(edges.limit(0)).first()) == (0, 0)


def test_degree_as_of_each_message(spark):
    rows = [(0, [1, 2]), (5, [1, 3]), (100, [1, 4]), (101, [1, 2])]
    episodes = topology.edge_episodes(topology.path_edges(paths_of(spark, rows)), 30, 10, 101)
    probes = spark.createDataFrame([(1, us, i) for i, (us, _) in enumerate(rows)], "asn long, event_us long, msg_id long")
    got = topology.degree_asof(episodes, probes, bucket_us=7).orderBy("msg_id").collect()
    assert [r.degree for r in got] == [1, 2, 1, 2]


def lines_of(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, value string")


def test_relationship_lines(spark):
    rels = parse_as_relationships(lines_of(spark, "# c\n1|2|-1|bgp\n3|4|0\nfree text\n5|6|1\n1|2|0"))
    assert sorted(map(tuple, rels.collect())) == [(1, 2, "peer"), (3, 4, "peer")]
    both = with_both_directions(parse_as_relationships(lines_of(spark, "1|2|-1")))
    assert sorted(map(tuple, both.collect())) == [(1, 2, "provider"), (2, 1, "customer")]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (7, 8)], "a long, b long")
    assert {(r.a, r.b): r.rel for r in detect.relationship_lookup(pairs, rels).collect()} == {(1, 2): "peer", (2, 1): "peer", (7, 8): "unknown"}


def test_degree_heuristic(spark):
    degrees = spark.createDataFrame([(1, 21), (2, 1), (3, 5)], "asn long, degree long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 9), (2, 3), (2, 2)], "a long, b long")
    got = {(r.a, r.b): r.rel for r in detect.degree_relationship(pairs, degrees, 4.0).collect()}
    assert got == {(1, 2): "provider", (2, 1): "customer", (1, 9): "unknown", (2, 3): "customer", (2, 2): "peer"}


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_single_pass(spark, seed):
    rng = random.Random(seed)
    lines = [(rng.randrange(8), rng.randrange(8), rng.choice([-1, 0])) for _ in range(25)]
    rels = parse_as_relationships(lines_of(spark, "\n".join(f"{a}|{b}|{r}" for a, b, r in lines if a != b)))
    known = {(r.a, r.b): r.rel for r in rels.collect()}
    flip = {"provider": "customer", "peer": "peer"}
    rel = lambda a, b: known.get((a, b)) or flip.get(known.get((b, a)), "unknown")
    messages = [(i, i * 7, [rng.randrange(8) for _ in range(rng.randrange(6))]) for i in range(300)]
    updates = spark.createDataFrame(messages, "msg_id long, event_us long, path array<long>")
    found = detect.path_leaks(detect.valley_apexes(updates, rels))
    want = list(interpreter.leaks(messages, rel, 60))
    assert sorted((r.msg_id, r.offending_asn, r.violations) for r in found.collect()) == sorted(w[:3] for w in want)
    for spread_us in (25, 1 << 40):
        assert sorted(r.msg_id for r in detect.suppress_repeats(found, 60, spread_us).collect()) == sorted(w[0] for w in want if w[3])
    assert {r.severity for r in found.filter("violations > 1").collect()} <= {2}


@pytest.mark.parametrize("seed", range(2))
def test_leaks_by_degrees_of_the_moment(spark, seed):
    """Roles change as edges come and go; degrees are counted anew for each message."""
    rng = random.Random(seed)
    us, messages = 0, []
    for i in range(200):
        us += rng.choice([1, 5, 40])
        messages.append((i, us, [rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(rng.randrange(6))]))
    updates = spark.createDataFrame(messages, "msg_id long, event_us long, path array<long>")
    episodes = topology.edge_episodes(topology.path_edges(updates), 30, 10, us, spread_us=50)
    found = detect.path_leaks(detect.valley_apexes_by_degree(updates, episodes, ratio=2.0, bucket_us=25))
    want, links = [], {}
    for i, us, path in messages:
        tick = (us - 1) // 10 * 10  # the last sweep before the message
        links = {k: seen for k, seen in links.items() if not (seen // 10 + 4) * 10 <= tick}
        links |= {(min(a, b), max(a, b)): us for a, b in zip(path, path[1:], strict=False) if a != b}
        degree = lambda x, links=links: sum(x in k for k in links)

        def rel(a, b, degree=degree):
            da, db = degree(a), degree(b)
            return "unknown" if not da or not db else "provider" if da >= 2 * db else "customer" if db >= 2 * da else "peer"

        hits = [path[k] for k in range(len(path) - 2, 0, -1) if {rel(path[k], path[k + 1]), rel(path[k], path[k - 1])} <= {"customer", "peer"}]
        if hits:
            want.append((i, hits[0], len(hits), path))
    assert sorted((r.msg_id, r.offending_asn, r.violations, r.path) for r in found.collect()) == want != []


def test_leak_at_exact_window_is_reported(spark):
    rows = spark.createDataFrame([(0, 0, 5), (1, 60, 5), (2, 119, 5), (3, 120, 5)], "msg_id long, event_us long, offending_asn long")
    assert sorted(r.msg_id for r in detect.suppress_repeats(rows, 60).collect()) == [0, 1]


@pytest.mark.parametrize("seed", range(2))
def test_churn_against_single_pass(spark, seed):
    rng = random.Random(seed)
    us, rows = 0, []
    for i in range(700):
        us += 0 if rng.random() < 0.2 else rng.choice([1, 2, 30])
        rows.append((i, us, f"10.{0 if 300 < i < 360 else rng.randrange(4)}.0.0/16", 1 if 300 < i < 360 else rng.randrange(3)))
    df = normalise_prefixes(spark.createDataFrame([(i, u, 0, "A", p, q) for i, u, p, q in rows], "msg_id long, event_us long, pos int, op string, prefix string, peer_asn long"))
    options = {"min_updates": 4, "deviations": 1.5, "floor": 3.0, "baseline": 64}
    want = list(interpreter.churn(rows, 50, 1.5, 3.0, 4, capacity=64))
    counts = detect.vantage_counts(df, 50, 60)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, detect.vantage_counts(df, 50, 1 << 40).collect()))
    fired = detect.detect_churn(detect.churn_threshold(counts, **options, bucket_us=100), 4, spread_us=60).orderBy("msg_id").collect()
    assert [(r.msg_id, r.n_updates) for r in fired] == [w[:2] for w in want]
    assert all(abs(r.threshold - w[2]) < 1e-9 for r, w in zip(fired, want, strict=True))


def test_count_of_exactly_the_floor_is_quiet(spark):
    df = normalise_prefixes(spark.createDataFrame([(i, i, 0, "A", "10.0.0.0/8", 1) for i in range(21)], "msg_id long, event_us long, pos int, op string, prefix string, peer_asn long"))
    fired = detect.detect_churn(detect.churn_threshold(detect.vantage_counts(df))).collect()
    assert [(r.msg_id, r.n_updates, r.severity) for r in fired] == [(20, 21, 1)]


def test_global_index_is_dense(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("event_us"), F.col("id").alias("msg_id"), F.lit(0).alias("pos"))
    got = detect.with_global_index(rows, bucket_us=10).orderBy("event_us", "msg_id").collect()
    assert [r.g for r in got] == list(range(500))
