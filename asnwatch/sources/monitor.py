"""Monitor samples: CSV files and stored scrapes of text metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.schemas import MONITOR_SAMPLES

# Metric names, without the namespace before them, and kinds of anomaly, by sample column.
METRICS = {
    "msgs": "messages_processed_total",
    "nodes": "graph_nodes",
    "edges": "graph_edges",
    "dropped": "ingest_dropped_total",
    "deltas": "deltas_broadcast_total",
    "clients": "connected_clients",
}
ANOMALIES = {"hijack": "prefix_hijack", "leak": "path_leak", "churn": "route_churn"}


def read_monitor_samples(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in the order of MONITOR_SAMPLES; -1 bytes mean that the socket was not measured."""
    return clean_samples(spark.read.schema(MONITOR_SAMPLES).option("header", True).csv(path))


def clean_samples(samples: DataFrame) -> DataFrame:
    return samples.withColumn("sock_rx", F.when(F.col("sock_rx") != -1, F.col("sock_rx")))


def metrics_text_to_samples(lines: DataFrame, value: str = "value", by: tuple[str, ...] = ("run_id", "scrape_ts"), line_no: str = "line_no") -> DataFrame:
    """Counters of each scrape from its lines ``name{labels} number``. Comments are skipped, numbers cut to
    integers, absent and unreadable ones 0; of repeated series the last line counts."""
    line = F.trim(value)
    key = F.regexp_replace(line, r"\s+\S*$", "")
    number = F.coalesce(F.greatest(F.regexp_extract(line, r"\s(\S+)$", 1).try_cast("double"), F.lit(0.0)).cast("bigint"), F.lit(0))
    name = F.regexp_extract(key, r"^[A-Za-z_:][A-Za-z0-9_:]*", 0)
    plain = F.coalesce(*[F.when(key.rlike(f"^([A-Za-z0-9:]+_)?{m}$"), c) for c, m in METRICS.items()])
    kinds = F.coalesce(*[F.when(key.contains(m), c) for c, m in ANOMALIES.items()])
    found = lines.filter(~F.col(value).startswith("#") & line.rlike(r"\s")).select(
        *by, F.when(name.endswith("anomalies_detected_total"), kinds).otherwise(plain).alias("metric"), number.alias("n"), F.col(line_no)
    )
    columns = ["msgs", "hijack", "leak", "churn", "nodes", "edges", "dropped", "deltas", "clients"]
    return found.groupBy(*by).agg(*[F.coalesce(F.max_by(F.when(F.col("metric") == c, F.col("n")), F.when(F.col("metric") == c, F.col(line_no))), F.lit(0)).alias(c) for c in columns])
