"""The change feed: link and area frames, their wire form, and the state that a reader of them holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_UP, LINK_DOWN, AREA = "LinkUp", "LinkDown", "AreaDegraded"
#: The total order of frames.
ORDER = ("event_us", "msg_id", "stage", "pos")
#: Sweeps come after all messages of their time.
SWEEP = (1 << 63) - 1
_TYPES = {"event_us": "bigint", "msg_id": "bigint", "stage": "int", "pos": "int", "kind": "string", "a": "bigint", "b": "bigint", "region": "string", "severity": "float"}


def as_frames(df: DataFrame) -> DataFrame:
    """The columns of a frame, absent ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()])


def deltas(link_ups: DataFrame | None = None, link_downs: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """All frames in one table with their order: of a message first its new links, then its anomalies' areas;
    links that a sweep takes down after the messages of that time."""
    parts = []
    if link_ups is not None:
        parts.append(as_frames(link_ups.withColumns({"kind": F.lit(LINK_UP), "stage": F.lit(0), "pos": F.col("hop")})))
    if areas is not None:
        parts.append(as_frames(areas.withColumns({"kind": F.lit(AREA), "severity": F.col("severity_index")})))
    if link_downs is not None:
        parts.append(as_frames(link_downs.withColumns({"kind": F.lit(LINK_DOWN), "msg_id": F.lit(SWEEP), "stage": F.lit(9), "pos": F.lit(0)})))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def delta_frames(frames: DataFrame) -> DataFrame:
    """Add ``value``: one JSON object a frame, absent fields left out."""
    return frames.withColumn("value", F.to_json(F.struct("kind", "a", "b", "region", "severity")))


def _links(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("kind").isin(LINK_UP, LINK_DOWN)).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})


def current_links(frames: DataFrame) -> DataFrame:
    """Links whose last frame brought them up. Repeated frames change nothing."""
    last = _links(frames).groupBy("lo", "hi").agg(F.max_by("kind", F.struct(*ORDER)).alias("kind"), F.max_by("event_us", F.struct(*ORDER)).alias("since_us"))
    return last.filter(F.col("kind") == LINK_UP).drop("kind")


def current_nodes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("lo", "hi")).alias("asn")).distinct()


def region_severity(frames: DataFrame) -> DataFrame:
    """The last weight of each region, which need not be its worst."""
    return frames.filter(F.col("kind") == AREA).groupBy("region").agg(F.max_by("severity", F.struct(*ORDER)).alias("severity"))


def delta_counts(frames: DataFrame) -> DataFrame:
    """Frames and bytes on the wire by kind."""
    return delta_frames(frames).groupBy("kind").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("value")).alias("n_bytes"))


def snapshot_frames(edges: DataFrame, most: int | None = 2000) -> DataFrame:
    """What a new reader is sent first: up to ``most`` live links, or all, as frames."""
    from asnwatch.operators.topology import snapshot_edges

    return as_frames(snapshot_edges(edges, most).withColumns({"kind": F.lit(LINK_UP), "a": F.col("lo"), "b": F.col("hi"), "event_us": F.col("last_seen_us"), "stage": F.lit(0), "pos": F.lit(0), "msg_id": F.lit(0)}))
