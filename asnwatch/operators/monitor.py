"""Run reports from monitor samples and logs; every operator is keyed by run, so a fleet's runs are one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What marks a line of the log.
PANIC, CONNECTED, LOADED = "panicked at", "subscribed to UPDATE stream", "AS relationships"
_BY = ("run_id",)
#: Seconds of a run whose samples one task numbers.
SPAN_S = 86_400


def pipeline_counters(updates: DataFrame, anomalies: DataFrame | None = None, frames: DataFrame | None = None, bucket: str = "1 day", late: DataFrame | None = None) -> DataFrame:
    """Messages and, of what is given, anomalies by kind, frames and ``late`` messages by bucket of time."""
    start = F.window(F.timestamp_micros("event_us"), bucket)["start"].alias("bucket_start")
    parts = [updates.select(start, F.lit("messages").alias("counter"))]
    if anomalies is not None:
        parts.append(anomalies.select(start, F.concat(F.lit("anomalies:"), "kind").alias("counter")))
    if frames is not None:
        parts.append(frames.select(start, F.lit("deltas").alias("counter")))
    if late is not None:
        parts.append(late.select(start, F.lit("late").alias("counter")))
    return reduce(DataFrame.union, parts).groupBy("bucket_start", "counter").agg(F.count("*").alias("n"))


def _ends(samples: DataFrame, columns: list[str]) -> list:
    return [f(c, "elapsed_s").alias(f"{n}_{c}") for c in columns for n, f in (("first", F.min_by), ("last", F.max_by))]


def counter_delta_with_reset(samples: DataFrame, column: str = "sock_rx") -> DataFrame:
    """(run_id, measured, delta, reset): last less first; a counter that fell was reset, then its last value
    counts and is approximate. A null at either end means unmeasured."""
    ends = samples.groupBy(*_BY).agg(*_ends(samples, [column]))
    first, last = F.col(f"first_{column}"), F.col(f"last_{column}")
    measured = first.isNotNull() & last.isNotNull()
    return ends.select(*_BY, measured.alias("measured"), F.when(measured, F.when(last >= first, last - first).otherwise(last)).otherwise(0).alias("delta"), (measured & (last < first)).alias("reset"))


def run_summary(samples: DataFrame, clk_tck: int = 100, nproc: int = 4) -> DataFrame:
    """Headline figures of each run from its first and last sample and averages over all."""
    ends = samples.groupBy(*_BY).agg(
        F.count("*").alias("samples"),
        (F.max("elapsed_s") - F.min("elapsed_s")).alias("_span"),
        (F.avg("rss_kb") / 1024).alias("rss_avg_mib"),
        (F.max("rss_kb") / 1024).alias("rss_peak_mib"),
        F.max("clients").alias("clients_peak"),
        *_ends(samples, ["cpu_ticks", "msgs", "dropped", "sock_rx"]),
    )
    window = F.greatest("_span", F.lit(1))
    positive = lambda c: F.greatest(F.col(f"last_{c}") - F.col(f"first_{c}"), F.lit(0))
    rx = counter_delta_with_reset(samples)
    cpu = positive("cpu_ticks") / float(max(clk_tck, 1)) / window * 100
    msgs = positive("msgs")
    ratio = F.when(msgs + F.col("last_dropped") > 0, F.col("last_dropped") / (msgs + F.col("last_dropped")) * 100).otherwise(0.0)
    return ends.join(rx, list(_BY)).select(
        *_BY, "samples", window.alias("window_s"), cpu.alias("cpu_core_pct"), (cpu / max(nproc, 1)).alias("cpu_host_pct"), "rss_avg_mib", "rss_peak_mib",
        "measured", F.col("reset").alias("reconnected"), (F.col("delta") / window / 1024).alias("ingress_kib_s"),
        msgs.alias("msgs_total"), (msgs / window).alias("msgs_per_s"), F.when((msgs > 0) & F.col("measured"), F.col("delta") / msgs).alias("bytes_per_msg"),
        F.col("last_dropped").alias("dropped"), ratio.alias("drop_ratio_pct"), "clients_peak",
    )


def rate_series(samples: DataFrame, target_rows: int = 12, span_s: int = SPAN_S) -> DataFrame:
    """About ``target_rows`` samples of each run, evenly spaced, with the message rate since the one kept before. Samples are
    numbered within spans of ``span_s``, which go on from the sizes of those before, so that a long run is spread; only
    what is kept of a run meets."""
    timed = samples.withColumn("_span", F.expr(f"elapsed_s div {span_s}L"))
    sizes = timed.groupBy(*_BY, "_span").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*_BY).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    step = F.greatest(F.floor(F.sum("_size").over(Window.partitionBy(*_BY)) / target_rows), F.lit(1))
    spans = sizes.select(*_BY, "_span", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), step.alias("_step"))
    place = F.row_number().over(Window.partitionBy(*_BY, "_span").orderBy("elapsed_s")) - 1
    kept = timed.withColumn("_place", place).join(spans, [*_BY, "_span"]).filter("(_before + _place) % _step = 0")
    order = Window.partitionBy(*_BY).orderBy("elapsed_s")
    dt = F.greatest(F.col("elapsed_s") - F.lag("elapsed_s").over(order), F.lit(1))
    rate = F.coalesce(F.greatest(F.col("msgs") - F.lag("msgs").over(order), F.lit(0)) / dt, F.lit(0.0))
    return kept.withColumn("msgs_per_s", rate).select(*_BY, "elapsed_s", "rss_kb", "msgs", "msgs_per_s", "nodes", "edges", "dropped", "clients")


def clean_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines without colour codes, and their level, the second word."""
    text = F.regexp_replace(value, "\\x1b\\[[^@-~]*[@-~]", "")
    return lines.withColumn("line", text).withColumn("level", F.get(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), F.lit(1)))


def log_summary(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """Counts of each run's log."""
    n = lambda c: F.count_if(c)
    has = lambda s: F.contains("line", F.lit(s))
    return clean_log(lines, value).groupBy(*_BY).agg(
        *[n(F.col("level") == level).alias(level.lower()) for level in ("INFO", "WARN", "ERROR")],
        n(has(PANIC)).alias("panics"), n(has(CONNECTED)).alias("connections"), F.coalesce(F.bool_or(has(LOADED)), F.lit(False)).alias("dataset_loaded"),
    )


def log_excerpt(lines: DataFrame, problems: int = 20, head: int = 25, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """The first ``head`` lines of each run and its first ``problems`` warnings and errors: part, place, line."""
    marked = clean_log(lines, value)
    order = Window.partitionBy(*_BY).orderBy(line_no)
    take = lambda df, part, most: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(*_BY, F.lit(part).alias("part"), "place", "line")
    return take(marked, "head", head).union(take(marked.filter(F.col("level").isin("WARN", "ERROR")), "problem", problems))


def run_verdict(summary: DataFrame, log: DataFrame, died: DataFrame) -> DataFrame:
    """(run_id, verdict) from the reports and from ``died`` (run_id of runs that did not last): FAIL after a crash
    or panic, WARN without messages, with errors, or with over 1 % dropped, else PASS."""
    gone = died.select(*_BY).distinct().withColumn("_died", F.lit(True))
    rows = summary.join(log, list(_BY), "left").join(gone, list(_BY), "left")
    fail = F.col("_died").isNotNull() | (F.coalesce("panics", F.lit(0)) > 0)
    warn = (F.col("msgs_total") == 0) | (F.coalesce("error", F.lit(0)) > 0) | (F.col("drop_ratio_pct") > 1)
    return rows.select(*_BY, F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS").alias("verdict"))
