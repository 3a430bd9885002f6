"""Routing tables derived from the star schema's tables, so that operators can be run on data of any size.

``events`` gives the stream of messages (one announcement or withdrawal each, 16 users share one busy
prefix), ``lineitem`` a larger graph, ``nation`` the regions. All by integer arithmetic on the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.schemas import ANNOUNCEMENTS
from asnwatch.sources.blocks import geo_blocks

HOUR = 3_600_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder beside the checkpoints, which all executors share; on one machine it may be a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/{kind}-{uuid.uuid4()}"


def micros(column: str = "ts"):
    """Microseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def event_fields(events: DataFrame) -> DataFrame:
    """The numbers that messages are made of."""
    rows = events.select(
        "event_id", "user_id", "event_type", micros().alias("event_us"),
        F.expr("(event_id * 7919 + user_id * 104729) % 1000003").alias("m"),
        F.expr("case when user_id % 16 = 0 then 0 else user_id end").alias("uid"),
    )
    return rows.selectExpr(
        "event_id as msg_id", "user_id", "event_us", "event_type", "m", "uid", "64500 + event_id % 5 as peer_asn",
        "case uid % 3 when 0 then 24 when 1 then 16 else 20 end as len",
        "167772160 + (uid % 16) * 65536 + ((uid * 37) % 256) * 256 as addr",
        "case when uid = 0 then 65000 + m % 40 else 65000 + uid + case when m % 20 = 0 then 1000 when m % 97 = 0 then 2000 + m % 23 else 0 end end as origin",
        "100 + m % 12 as t1", "200 + m % 30 as t2",
        "event_type = 'purchase' and m % 4 = 0 and uid <> 0 as withdraws",
    )


def _with_prefix(rows: DataFrame) -> DataFrame:
    net = rows.withColumn("net", F.expr("addr - addr % shiftleft(1L, 32 - len)"))
    return net.withColumn("prefix", F.expr("concat_ws('.', net div 16777216, (net div 65536) % 256, (net div 256) % 256, net % 256) || '/' || len"))


_PATH = "case when withdraws then cast(array() as array<bigint>) when m % 10 = 0 then array(peer_asn, t1, t2, t2, origin) else array(peer_asn, t1, t2, origin) end"


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages; columns as in ``schemas.UPDATES``."""
    return message_rows(table(spark, sf_dir, "events"))


def message_rows(events: DataFrame) -> DataFrame:
    """The same for any rows of ``events``, also a stream of them."""
    rows = _with_prefix(event_fields(events))
    return rows.select(
        "msg_id", "event_us", F.timestamp_micros("event_us").alias("event_ts"),
        F.concat(F.lit("rrc0"), F.expr("m % 3").cast("string")).alias("host"), F.lit("192.0.2.1").alias("peer"), "peer_asn", F.lit("UPDATE").alias("msg_type"),
        F.expr(_PATH).alias("path"), F.lit("IGP").alias("origin_attr"),
        F.expr(f"case when withdraws then cast(array() as {ANNOUNCEMENTS}) else array(named_struct('next_hop', '192.0.2.1', 'prefixes', array(prefix))) end").alias("announcements"),
        F.expr("case when withdraws then array(prefix) else cast(array() as array<string>) end").alias("withdrawals"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON frames as a feed would send them (value, msg_id), some of them control frames and some broken."""
    return frame_rows(table(spark, sf_dir, "events"))


def frame_rows(events: DataFrame) -> DataFrame:
    """The same for any rows of ``events``, in their order."""
    rows = _with_prefix(event_fields(events))
    body = F.to_json(F.struct(
        F.lit("ris_message").alias("type"),
        F.struct(
            (F.col("event_us") / 1_000_000).alias("timestamp"), F.lit("192.0.2.1").alias("peer"),
            F.when(F.expr("m % 7 = 0"), F.concat(F.lit(" "), F.col("peer_asn").cast("string"))).otherwise(F.col("peer_asn").cast("string")).alias("peer_asn"),
            F.when(F.expr("m % 9 = 0"), "ROUTE").otherwise("UPDATE").alias("type"),
            F.expr("transform(" + _PATH + ", x -> cast(x as string))").alias("path"),
            F.expr(f"case when withdraws then cast(array() as {ANNOUNCEMENTS}) else array(named_struct('next_hop', '192.0.2.1', 'prefixes', array(case when m % 50 = 3 then '10.0.0.0/33' else prefix end))) end").alias("announcements"),
            F.expr("case when withdraws then array(prefix) else cast(array() as array<string>) end").alias("withdrawals"),
        ).alias("data"),
    ))
    # ASNs as numbers, the last hop now and then as a set.
    numbers = F.regexp_replace(F.regexp_replace(body, r'"([0-9]+)"(?=[,\]])', "$1"), r'"path":\[([0-9,]*),([0-9]+)\]', F.when(F.expr("m % 6 = 1"), r'"path":[$1,[$2,64999]]').otherwise(r'"path":[$1,$2]'))
    value = (
        F.when(F.expr("m % 40 = 5"), F.lit('{"type":"pong"}'))
        .when(F.expr("m % 41 = 6"), F.substring(numbers, 1, 60))
        .otherwise(numbers)
    )
    return rows.select("msg_id", value.alias("value"), "event_us")


def relationship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines a|b|rel of a dataset file (value, line_no) for the pairs next to each other in the messages."""
    rows = event_fields(table(spark, sf_dir, "events")).filter("not withdraws")
    pairs = rows.selectExpr(
        "inline(array("
        "named_struct('a', t1, 'b', peer_asn, 'rel', case when (t1 + peer_asn) % 3 = 0 then '0' else '-1' end),"
        "named_struct('a', case when (t1 + t2) % 11 = 0 then t2 else t1 end, 'b', case when (t1 + t2) % 11 = 0 then t1 else t2 end, 'rel', case when (t1 + t2) % 11 <> 0 and (t1 + t2) % 7 = 0 then '0' else '-1' end),"
        "named_struct('a', case when origin % 9 = 0 then origin else t2 end, 'b', case when origin % 9 = 0 then t2 else origin end, 'rel', case when (t2 + origin) % 13 = 0 then 'x' else '-1' end)))"
    ).distinct()
    return pairs.select(F.concat_ws("|", "a", "b", "rel").alias("value"), F.expr("a * 4294967296 + b").alias("line_no"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 10.x.0.0/16 of nation x, a third without subdivision, and some /20 within them."""
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey as x", "concat('N', n_nationkey) as country")
    wide = nations.selectExpr("concat('10.', x, '.0.0/16') as network", "country", "case when x % 3 <> 0 then concat('S', x) end as subdivision")
    narrow = nations.filter("x % 2 = 1").selectExpr("concat('10.', x, '.', (x * 48) % 256 div 16 * 16, '.0/20') as network", "case when x = 5 then null else country end as country", "concat('T', x) as subdivision")
    return geo_blocks(wide.union(narrow))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger graph: supplier and part of each line item, observed on its ship date."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as msg_id", "unix_date(cast(l_shipdate as date)) * 86400000000L as event_us", "l_linenumber as hop",
        "cast(l_suppkey as bigint) as a", "cast(l_partkey + 10000000 as bigint) as b", "cast(l_suppkey as bigint) as lo", "cast(l_partkey + 10000000 as bigint) as hi",
    )


def monitor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of ten runs; counters grow, the byte counter of some runs falls or is not measured."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 10 as string) as run_id", "event_id as elapsed_s", "100000 + event_id % 777 as rss_kb", "event_id * 3 as cpu_ticks",
        "case when user_id % 10 = 3 and event_id % 2 = 0 then -1 when user_id % 10 = 4 then 5000000 - event_id * 17 else event_id * 1000 end as sock_rx",
        "case when user_id % 10 = 5 then 0 else event_id * 11 end as msgs", "event_id div 50 as hijack", "event_id div 60 as leak", "event_id div 70 as churn", "14000 + event_id % 100 as nodes", "33000 + event_id % 200 as edges",
        "case when user_id % 10 = 6 then event_id * 2 else 0 end as dropped", "event_id * 5 as deltas", "event_id % 13 as clients",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of ten runs (run_id, line_no, value), some lines in colour."""
    return event_fields(table(spark, sf_dir, "events")).selectExpr(
        "cast(user_id % 10 as string) as run_id", "msg_id as line_no",
        "concat('t', msg_id, ' ', case when m % 5 = 0 then concat(char(27), '[32m') else '' end, case when m % 211 = 0 and user_id % 10 < 3 then 'ERROR' when m % 37 = 0 then 'WARN' else 'INFO' end, case when m % 5 = 0 then concat(char(27), '[0m') else '' end,"
        " ' ', case when m % 997 = 0 and user_id % 10 = 1 then 'panicked at x' when m % 101 = 0 then 'feed: subscribed to UPDATE stream' when m % 499 = 0 then 'loaded AS relationships' else event_type end) as value",
    )


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scrapes: three lines for each event (run_id, scrape_ts, line_no, value)."""
    rows = table(spark, sf_dir, "events").withColumn("event_us", micros())
    return rows.selectExpr(
        "cast(user_id % 10 as string) as run_id", "event_us div 60000000 as scrape_ts", "event_id",
        "posexplode(array(concat('rib_messages_processed_total ', event_id, '.7'), concat('rib_anomalies_detected_total{kind=\"', case event_id % 3 when 0 then 'prefix_hijack' when 1 then 'path_leak' else 'route_churn' end, '\"} ', event_id % 91), case event_id % 4 when 0 then '# HELP x 5' when 1 then 'graph_nodes 1.2e3' when 2 then concat('rib_graph_edges  ', event_id % 17) else 'broken' end)) as (k, value)",
    ).selectExpr("run_id", "scrape_ts", "event_id * 3 + k as line_no", "value")
