"""Explicit schemas of the tables that the library reads and makes; nothing is ever inferred.

Times are microseconds since the epoch (``event_us``), the key of every order and window; ``msg_id`` and
``pos`` break ties, so that results do not depend on how rows are dealt out. ASNs are BIGINT, as
unsigned 32-bit numbers do not fit INT.
"""

from __future__ import annotations

ANNOUNCEMENTS = "array<struct<next_hop:string,prefixes:array<string>>>"

#: One feed message as JSON, fields as the feed writes them: numbers that may be quoted, nested AS sets.
FRAME = (
    "type string, data struct<timestamp:double,host:string,peer:string,peer_asn:string,type:string,path:array<string>,"
    f"origin:string,announcements:{ANNOUNCEMENTS},withdrawals:array<string>>"
)
UPDATES = (
    "msg_id bigint, event_us bigint, event_ts timestamp, host string, peer string, peer_asn bigint, msg_type string, "
    f"path array<bigint>, origin_attr string, announcements {ANNOUNCEMENTS}, withdrawals array<string>"
)
RELATIONSHIPS = "a bigint, b bigint, rel string"
GEO_BLOCKS = "family tinyint, prefix_len int, net_key string, country string, subdivision string"
ASN_BLOCKS = "family tinyint, prefix_len int, net_key string, asn bigint"
HISTORY = (
    "observed_at timestamp, kind string, severity smallint, prefix string, previous_origin bigint, new_origin bigint, "
    "offending_asn bigint, as_path array<bigint>, region string, updates_in_window int, threshold double, net_key string, family tinyint"
)
MONITOR_SAMPLES = (
    "run_id string, elapsed_s bigint, rss_kb bigint, cpu_ticks bigint, sock_rx bigint, msgs bigint, hijack bigint, leak bigint, "
    "churn bigint, nodes bigint, edges bigint, dropped bigint, deltas bigint, clients bigint"
)
