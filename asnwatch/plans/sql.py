"""The queries in DuckDB SQL, built from the same integer arithmetic as ``tables`` but in their own way."""

from __future__ import annotations

D = 86_400_000_000
H = 3_600_000_000

_PARTS = {
    "ev": "SELECT event_id, user_id, event_type, epoch_us(ts) AS event_us, (event_id * 7919 + user_id * 104729) % 1000003 AS m, CASE WHEN user_id % 16 = 0 THEN 0 ELSE user_id END AS uid FROM events",
    "msg": """SELECT event_id AS msg_id, user_id, event_us, event_type, m, uid, 64500 + event_id % 5 AS peer_asn,
        CAST(CASE uid % 3 WHEN 0 THEN 24 WHEN 1 THEN 16 ELSE 20 END AS INTEGER) AS plen, 167772160 + (uid % 16) * 65536 + ((uid * 37) % 256) * 256 AS addr,
        CASE WHEN uid = 0 THEN 65000 + m % 40 ELSE 65000 + uid + CASE WHEN m % 20 = 0 THEN 1000 WHEN m % 97 = 0 THEN 2000 + m % 23 ELSE 0 END END AS origin,
        100 + m % 12 AS t1, 200 + m % 30 AS t2, (event_type = 'purchase' AND m % 4 = 0 AND uid <> 0) AS withdraws FROM ev""",
    "net": "SELECT *, addr - addr % (1 << (32 - plen)) AS net FROM msg",
    "ops": """SELECT msg_id, event_us, peer_asn, 0 AS pos, CASE WHEN withdraws THEN 'W' ELSE 'A' END AS op,
        concat_ws('.', net // 16777216, (net // 65536) % 256, (net // 256) % 256, net % 256) || '/' || plen AS prefix, 4 AS family, plen AS prefix_len,
        substring(lpad(bin(net), 32, '0'), 1, plen) AS net_key, CASE WHEN NOT withdraws THEN origin END AS origin_asn FROM net""",
    "paths": "SELECT msg_id, event_us, withdraws, CASE WHEN withdraws THEN [] WHEN m % 10 = 0 THEN [peer_asn, t1, t2, t2, origin] ELSE [peer_asn, t1, t2, origin] END AS path FROM msg",
    "hops": "SELECT msg_id, event_us, hop, path[hop + 1] AS a, path[hop + 2] AS b FROM (SELECT *, unnest(range(0, greatest(len(path) - 1, 0))) AS hop FROM paths)",
    "edges": "SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM hops WHERE a <> b",
    "seen": "SELECT *, lag(event_us) OVER (PARTITION BY lo, hi ORDER BY event_us, msg_id, hop) AS before_us FROM edges",
    "numbered": f"SELECT *, sum(CASE WHEN before_us IS NULL OR event_us > ((before_us + {2 * D}) // {D} + 1) * {D} THEN 1 ELSE 0 END) OVER (PARTITION BY lo, hi ORDER BY event_us, msg_id, hop) AS episode FROM seen",
    "spans": "SELECT lo, hi, episode, arg_min(a, event_us * 10 + hop) AS a, arg_min(b, event_us * 10 + hop) AS b, min(event_us) AS up_us, arg_min(msg_id, event_us) AS up_msg_id, arg_min(hop, event_us * 10 + hop) AS up_hop, max(event_us) AS last_seen_us FROM numbered GROUP BY ALL",
    "latest": "SELECT max(event_us) AS as_of FROM ev",
    "episodes": f"""SELECT lo, hi, a, b, up_us, up_msg_id, up_hop, last_seen_us,
        CASE WHEN lead(episode) OVER (PARTITION BY lo, hi ORDER BY episode) IS NOT NULL OR ((last_seen_us + {2 * D}) // {D} + 1) * {D} < as_of THEN ((last_seen_us + {2 * D}) // {D} + 1) * {D} END AS down_us
        FROM spans, latest""",
    "live": "SELECT lo, hi, a, b, up_us, last_seen_us FROM episodes WHERE down_us IS NULL",
    "ends": "SELECT lo AS asn, hi AS peer FROM live UNION ALL SELECT hi, lo FROM live",
    "segments": "SELECT *, sum(CASE WHEN op = 'W' THEN 1 ELSE 0 END) OVER (PARTITION BY net_key ORDER BY event_us, msg_id, pos) AS segment FROM ops",
    "announced": "SELECT *, lag(origin_asn) OVER w AS previous_origin, row_number() OVER (PARTITION BY net_key, segment, origin_asn ORDER BY event_us, msg_id, pos) = 1 AS is_first FROM segments WHERE op = 'A' WINDOW w AS (PARTITION BY net_key, segment ORDER BY event_us, msg_id, pos)",
    "ranked": "SELECT *, sum(is_first::INT) OVER (PARTITION BY net_key, segment ORDER BY event_us, msg_id, pos) AS rk FROM announced",
    "observed": """SELECT *, previous_origin IS NOT NULL AND (is_first OR first_rk > 16) AS changed, CAST(least(rk, 16) AS INTEGER) AS distinct_origins
        FROM (SELECT *, min(rk) OVER (PARTITION BY net_key, segment, origin_asn) AS first_rk FROM ranked)""",
    "hijacks": "SELECT *, CAST(CASE WHEN distinct_origins >= 3 THEN 2 ELSE 1 END AS SMALLINT) AS severity FROM observed WHERE changed",
    "pairs": """SELECT DISTINCT a, b, rel FROM (
        SELECT t1 AS a, peer_asn AS b, CASE WHEN (t1 + peer_asn) % 3 = 0 THEN '0' ELSE '-1' END AS rel FROM msg WHERE NOT withdraws
        UNION ALL SELECT CASE WHEN (t1 + t2) % 11 = 0 THEN t2 ELSE t1 END, CASE WHEN (t1 + t2) % 11 = 0 THEN t1 ELSE t2 END, CASE WHEN (t1 + t2) % 11 <> 0 AND (t1 + t2) % 7 = 0 THEN '0' ELSE '-1' END FROM msg WHERE NOT withdraws
        UNION ALL SELECT CASE WHEN origin % 9 = 0 THEN origin ELSE t2 END, CASE WHEN origin % 9 = 0 THEN t2 ELSE origin END, CASE WHEN (t2 + origin) % 13 = 0 THEN 'x' ELSE '-1' END FROM msg WHERE NOT withdraws)""",
    "rels": "SELECT a, b, CASE rel WHEN '-1' THEN 'provider' ELSE 'peer' END AS rel FROM pairs WHERE rel <> 'x'",
    "sides": """SELECT a, b, arg_min(rel, turn) AS rel FROM (SELECT a, b, rel, 0 AS turn FROM rels UNION ALL SELECT b, a, CASE rel WHEN 'provider' THEN 'customer' ELSE rel END, 1 FROM rels) GROUP BY a, b""",
    "triples": "SELECT msg_id, event_us, i, path[i + 1] AS y, path[i + 2] AS learned_from, path[i] AS told FROM (SELECT *, unnest(range(1, len(path) - 1)) AS i FROM paths WHERE len(path) >= 3)",
    "apexes": "SELECT t.* FROM triples t JOIN sides r ON r.a = t.y AND r.b = t.learned_from JOIN sides o ON o.a = t.y AND o.b = t.told WHERE r.rel IN ('customer', 'peer') AND o.rel IN ('customer', 'peer')",
    "turns": """SELECT asn, event_us, msg_id, 0 AS turn, change FROM (SELECT unnest([lo, hi]) AS asn, up_us AS event_us, up_msg_id AS msg_id, 1 AS change FROM episodes
        UNION ALL SELECT unnest([lo, hi]), down_us, 9223372036854775807, -1 FROM episodes WHERE down_us IS NOT NULL)
        UNION ALL SELECT DISTINCT unnest(path), event_us, msg_id, 1, 0 FROM paths""",
    "moments": "SELECT asn, event_us, msg_id, n FROM (SELECT *, sum(change) OVER (PARTITION BY asn ORDER BY event_us, msg_id, turn) AS n FROM turns) WHERE turn = 1",
    "leaks": "SELECT msg_id, event_us, arg_max(y, i) AS offending_asn, CAST(count(*) AS INTEGER) AS violations, CAST(CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS SMALLINT) AS severity FROM apexes GROUP BY msg_id, event_us",
    "spaced": "SELECT *, event_us - lag(event_us) OVER (PARTITION BY offending_asn ORDER BY event_us, msg_id) AS gap FROM leaks",
    "reported": f"SELECT * FROM spaced WHERE gap IS NULL OR gap >= {D}",
    "vantage": f"""SELECT msg_id, event_us, pos, prefix, net_key, peer_asn, row_number() OVER (PARTITION BY prefix, peer_asn ORDER BY event_us, msg_id, pos) AS nth,
        CAST((SELECT count(*) FROM ops e WHERE e.op = 'A' AND e.prefix = o.prefix AND e.peer_asn = o.peer_asn AND e.event_us >= o.event_us - {3 * D} AND (e.event_us, e.msg_id, e.pos) <= (o.event_us, o.msg_id, o.pos)) AS INTEGER) AS n_updates
        FROM ops o WHERE op = 'A'""",
    "indexed": "SELECT *, row_number() OVER (ORDER BY event_us, msg_id, pos) - 1 AS g FROM vantage",
    "medians": "SELECT c.g, median(w.n_updates) AS med, count(*) AS n FROM indexed c JOIN indexed w ON w.g BETWEEN c.g - 1023 AND c.g WHERE c.n_updates >= 3 GROUP BY c.g",
    "thresholds": "SELECT m.g, CASE WHEN any_value(m.n) < 32 THEN 3.0 ELSE greatest(any_value(m.med) + 2 * 1.4826 * median(abs(w.n_updates - m.med)), 3.0) END AS threshold FROM medians m JOIN indexed w ON w.g BETWEEN m.g - 1023 AND m.g GROUP BY m.g",
    "above": "SELECT i.*, t.threshold, coalesce(i.n_updates >= 3 AND i.n_updates > t.threshold, false) AS is_above FROM indexed i LEFT JOIN thresholds t USING (g)",
    "churn": "SELECT *, CAST(CASE WHEN n_updates / threshold >= 2 THEN 2 ELSE 1 END AS SMALLINT) AS severity FROM (SELECT *, lag(is_above) OVER (PARTITION BY prefix, peer_asn ORDER BY event_us, msg_id, pos) AS was_above FROM above) WHERE is_above AND NOT coalesce(was_above, false)",
    "blocks": """SELECT substring(lpad(bin(167772160 + n_nationkey * 65536), 32, '0'), 1, 16) AS net_key, 16 AS prefix_len, 'N' || n_nationkey AS country, CASE WHEN n_nationkey % 3 <> 0 THEN 'S' || n_nationkey END AS subdivision FROM nation
        UNION ALL SELECT substring(lpad(bin(167772160 + n_nationkey * 65536 + (n_nationkey * 48) % 256 // 16 * 16 * 256), 32, '0'), 1, 20), 20, CASE WHEN n_nationkey <> 5 THEN 'N' || n_nationkey END, 'T' || n_nationkey FROM nation WHERE n_nationkey % 2 = 1""",
    "nets": "SELECT DISTINCT net_key, rpad(net_key, 32, '0') AS address FROM ops",
    "located": "SELECT n.net_key, arg_max(b.country, b.prefix_len) FILTER (true) AS c0, max(b.prefix_len) AS best FROM nets n JOIN blocks b ON starts_with(n.address, b.net_key) GROUP BY n.net_key",
    "areas": "SELECT l.net_key, CASE WHEN b.country IS NOT NULL THEN concat_ws('-', b.country, b.subdivision) END AS region FROM located l JOIN nets n USING (net_key) JOIN blocks b ON b.prefix_len = l.best AND starts_with(n.address, b.net_key)",
    "anomalies": """SELECT msg_id, event_us, 2 AS stage, pos, 'prefix_hijack' AS kind, severity, prefix, net_key, previous_origin, origin_asn AS new_origin, NULL::BIGINT AS offending_asn, NULL::INTEGER AS updates_in_window, NULL::DOUBLE AS threshold FROM hijacks
        UNION ALL SELECT msg_id, event_us, 1, 0, 'path_leak', severity, NULL, NULL, NULL, NULL, offending_asn, NULL, NULL FROM reported
        UNION ALL SELECT msg_id, event_us, 3, pos, 'route_churn', severity, prefix, net_key, NULL, NULL, NULL, n_updates, threshold FROM churn""",
    "history": "SELECT a.*, make_timestamp(event_us) AS observed_at, CAST(make_timestamp(event_us) AS DATE) AS day, r.region FROM anomalies a LEFT JOIN areas r USING (net_key)",
    "degraded": "SELECT *, [0.33, 0.66, 1.0][severity + 1]::FLOAT AS weight FROM history WHERE region IS NOT NULL",
    "deltas": """SELECT up_us AS event_us, up_msg_id AS msg_id, 0 AS stage, up_hop AS pos, 'LinkUp' AS kind, a, b, NULL AS region, NULL::FLOAT AS severity FROM episodes
        UNION ALL SELECT event_us, msg_id, stage, pos, 'AreaDegraded', NULL, NULL, region, weight FROM degraded
        UNION ALL SELECT down_us, 9223372036854775807, 9, 0, 'LinkDown', lo, hi, NULL, NULL FROM episodes WHERE down_us IS NOT NULL""",
    "samples": """SELECT CAST(user_id % 10 AS VARCHAR) AS run_id, event_id AS elapsed_s, 100000 + event_id % 777 AS rss_kb, event_id * 3 AS cpu_ticks,
        nullif(CASE WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN -1 WHEN user_id % 10 = 4 THEN 5000000 - event_id * 17 ELSE event_id * 1000 END, -1) AS sock_rx,
        CASE WHEN user_id % 10 = 5 THEN 0 ELSE event_id * 11 END AS msgs, event_id // 50 AS hijack, event_id // 60 AS leak, event_id // 70 AS churn, 14000 + event_id % 100 AS nodes, 33000 + event_id % 200 AS edges,
        CASE WHEN user_id % 10 = 6 THEN event_id * 2 ELSE 0 END AS dropped, event_id * 5 AS deltas, event_id % 13 AS clients FROM events""",
    "firstlast": "SELECT run_id, min(elapsed_s) AS e0, max(elapsed_s) AS e1, count(*) AS samples, avg(rss_kb) / 1024 AS rss_avg_mib, max(rss_kb) / 1024.0 AS rss_peak_mib, max(clients) AS clients_peak FROM samples GROUP BY run_id",
    "summary": """SELECT f.*, greatest(e1 - e0, 1) AS window_s, l.cpu_ticks - a.cpu_ticks AS ticks, greatest(l.msgs - a.msgs, 0) AS msgs_total, l.dropped AS dropped,
        a.sock_rx IS NOT NULL AND l.sock_rx IS NOT NULL AS measured, coalesce(l.sock_rx < a.sock_rx, false) AS reconnected,
        CASE WHEN a.sock_rx IS NULL OR l.sock_rx IS NULL THEN 0 WHEN l.sock_rx >= a.sock_rx THEN l.sock_rx - a.sock_rx ELSE l.sock_rx END AS rx
        FROM firstlast f JOIN samples a ON a.run_id = f.run_id AND a.elapsed_s = e0 JOIN samples l ON l.run_id = f.run_id AND l.elapsed_s = e1""",
    "loglines": """SELECT CAST(user_id % 10 AS VARCHAR) AS run_id, event_id AS line_no, CASE WHEN m % 211 = 0 AND user_id % 10 < 3 THEN 'ERROR' WHEN m % 37 = 0 THEN 'WARN' ELSE 'INFO' END AS level,
        CASE WHEN m % 997 = 0 AND user_id % 10 = 1 THEN 'panicked at x' WHEN m % 101 = 0 THEN 'feed: subscribed to UPDATE stream' WHEN m % 499 = 0 THEN 'loaded AS relationships' ELSE event_type END AS said FROM ev""",
    "logsum": "SELECT run_id, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARN') AS warn, count(*) FILTER (level = 'ERROR') AS error, count(*) FILTER (said LIKE 'panicked%') AS panics, count(*) FILTER (said LIKE '%subscribed to UPDATE%') AS connections, bool_or(said LIKE 'loaded%') AS dataset_loaded FROM loglines GROUP BY run_id",
}


#: In place of parts above, for what is read from frames: those that are neither control frames nor broken, with AS sets.
_DECODED = {
    "decoded": "SELECT * FROM msg WHERE NOT (m % 40 = 5 OR m % 41 = 6 OR (m % 50 = 3 AND NOT withdraws))",
    "net": "SELECT *, addr - addr % (1 << (32 - plen)) AS net FROM decoded",
    "ops": _PARTS["ops"].replace("THEN origin END AS origin_asn", "THEN CASE WHEN m % 6 = 1 THEN 64999 ELSE origin END END AS origin_asn"),
    "paths": """SELECT msg_id, event_us, withdraws, CASE WHEN withdraws THEN [] ELSE [peer_asn, t1, t2] || CASE WHEN m % 10 = 0 THEN [t2] ELSE [] END || [origin]
        || CASE WHEN m % 6 = 1 THEN [64999] ELSE [] END END AS path FROM decoded""",
}


def sql(select: str, decoded: bool = False) -> str:
    """``select`` with the parts that it names, and those that they name, as common table expressions."""
    import re

    parts = {**_PARTS, **_DECODED} if decoded else _PARTS
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|from|join|,)\s*\(?\s*([a-z]\w*)", text):
            if name in parts and name not in needed:
                add(parts[name])
                needed.append(name)

    add(select)
    return ("WITH " + ", ".join(f"{n} AS ({parts[n]})" for n in needed) + " " if needed else "") + select
