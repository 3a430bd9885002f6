"""Feed messages: JSON frames to the table ``updates``, with control frames and bad frames told apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asnwatch.functions.messages import as_number, event_us, flatten_as_path, normalise_msg_type, normalise_peer_asn, once
from asnwatch.functions.prefixes import is_prefix
from asnwatch.operators.spread import drop_versions, stored
from asnwatch.schemas import ANNOUNCEMENTS, FRAME, UPDATES

ROUTING = "ris_message"
#: Bits of an id that number a line, below those that number its file.
LINE_BITS = 36
#: Splits up to this number are broadcast (a path and three numbers each), beyond it joined by shuffle.
BROADCAST_SPLITS = 500_000


def _all(items: Column, ok) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(True))


def parse_frames(raw: DataFrame, value: str = "value") -> DataFrame:
    """Add ``frame`` (FRAME), the fields that are checked as columns (_path, _peer_asn, _announced) and ``outcome``
    to JSON texts: routing, control or quarantine. A frame is rejected whole if its JSON is broken or a prefix,
    path element or peer ASN of it is bad."""
    frame = F.from_json(F.col(value), f"{FRAME}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    data = F.col("frame.data")
    parsed = once(once(raw, frame=frame), _path=flatten_as_path(data["path"]), _peer_asn=normalise_peer_asn(data["peer_asn"]))
    announced = F.flatten(F.transform(data["announcements"], lambda a: F.coalesce(a["prefixes"], F.array().cast("array<string>"))))
    good = (
        (data["peer_asn"].isNull() | F.col("_peer_asn").isNotNull())
        & _all(F.col("_path"), lambda x: x.isNotNull())
        & _all(announced, is_prefix)
        & _all(data["withdrawals"], is_prefix)
    )
    outcome = (
        F.when(F.col("frame").isNull() | F.col("frame._corrupt").isNotNull() | F.col("frame.type").isNull(), "quarantine")
        .when(F.col("frame.type") != ROUTING, "control")
        .when(data.isNotNull() & good, "routing")
        .otherwise("quarantine")
    )
    return once(parsed, outcome=outcome)


def to_updates(parsed: DataFrame, msg_id: str = "msg_id", fallback_us: Column | None = None) -> DataFrame:
    """The routing frames of ``parse_frames`` as ``updates``. ``msg_id`` must order frames stably (a file's
    line, a topic's offset); messages without a time of their own get ``fallback_us``."""
    data = F.col("frame.data")
    us = event_us(data["timestamp"], F.lit(0).cast("bigint") if fallback_us is None else fallback_us)
    return parsed.filter("outcome = 'routing'").select(
        F.col(msg_id).cast("bigint").alias("msg_id"),
        us.alias("event_us"),
        F.timestamp_micros(us).alias("event_ts"),
        data["host"].alias("host"),
        data["peer"].alias("peer"),
        F.col("_peer_asn").alias("peer_asn"),
        normalise_msg_type(data["type"]).alias("msg_type"),
        F.coalesce("_path", F.array().cast("array<bigint>")).alias("path"),
        data["origin"].alias("origin_attr"),
        F.coalesce(data["announcements"], F.array().cast(ANNOUNCEMENTS)).alias("announcements"),
        F.coalesce(data["withdrawals"], F.array().cast("array<string>")).alias("withdrawals"),
    )


def split_frames(raw: DataFrame, value: str = "value", msg_id: str = "msg_id", fallback_us: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updates, control frames, quarantined frames)."""
    parsed = parse_frames(raw, value)
    rest = parsed.drop("frame", "_path", "_peer_asn")
    return to_updates(parsed, msg_id, fallback_us), rest.filter("outcome = 'control'"), rest.filter("outcome = 'quarantine'")


def frame_counts(raw: DataFrame, value: str = "value") -> DataFrame:
    return parse_frames(raw, value).groupBy("outcome").agg(F.count("*").alias("n_frames"))


def file_lines(frames: DataFrame) -> DataFrame:
    """Of a text reader's rows, also of a stream: value, and where it comes from: _file, and _block, the start of the split."""
    return frames.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered_files(splits: DataFrame, first: int = 0) -> DataFrame:
    """(_file, _number): files in the order of their names, from ``first`` on. Names are sorted folder by folder."""
    names = splits.select("_file").distinct().withColumn("_folder", F.regexp_replace("_file", "[^/]*$", ""))
    sizes = names.groupBy("_folder").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)  # a row a folder
    opening = sizes.select("_folder", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + first - 1).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_folder").orderBy("_file"))
    return names.withColumn("_place", place).join(opening, "_folder").select("_file", (F.col("_before") + F.col("_place")).alias("_number"))


def with_line_numbers(lines: DataFrame, files: DataFrame | None = None, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lines with ``msg_id``, files with their numbers): the file's number and the line's within it, from 0, as one number.

    A task counts the lines of its splits; the splits' counts, a row each, are summed along each file, so that ids do not
    depend on how files are cut into splits. ``files`` (_file, _number) are numbers given before; else files are
    numbered by name. The rows of a split lie one after the other in a task."""
    rows = lines.withColumn("_row", F.monotonically_increasing_id())
    splits = stored(rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    numbers = numbered_files(splits, first) if files is None else files.select("_file", "_number")
    along = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_lines", F.coalesce(F.sum("_n").over(along), F.lit(0))).join(numbers, "_file")
    start = before.select("_file", "_block", (F.shiftleft("_number", LINE_BITS) + F.col("_lines") - F.col("_first")).alias("_start"))
    side = F.broadcast(start) if splits.count() <= BROADCAST_SPLITS else start
    return rows.join(side, ["_file", "_block"]).withColumn("msg_id", F.col("_start") + F.col("_row")).drop("_start", "_row", "_block", "_file"), numbers


def read_updates(spark: SparkSession, path: str | list[str], fallback_us: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Frames from text files, one a line. ``msg_id`` is (file, line): files in the order of their names, or by the numbers
    that ``file_numbers`` has of those that a stream has taken, so that batch and stream agree. Lines are counted in a
    first pass, without parsing them."""
    numbered, _ = with_line_numbers(file_lines(spark.read.text(path)), files)
    return split_frames(numbered, fallback_us=fallback_us)[0]


def stream_frames(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of the lines of text files that arrive in a folder, for ``numbered_batches``."""
    return file_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def numbered_batches(sink: Callable[[DataFrame, int], None], path: str, fallback_us: Column | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``stream_frames``: ``sink`` gets the updates of each batch with ids (file, line). A file comes in
    one batch; its number goes on from those of the batches before, by name within a batch, and is kept under ``path``. A
    replayed batch gives the same ids."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = spark.read.schema("next long").parquet(f"{path}/next/{number - 1}").first() if number else None
        first = top["next"] if top else 0
        numbered, files = with_line_numbers(batch, first=first)
        files = stored(files)
        sink(split_frames(numbered, fallback_us=fallback_us)[0], number)
        files.write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        files.agg(F.coalesce(F.max("_number") + 1, F.lit(first)).alias("next")).write.mode("overwrite").parquet(f"{path}/next/{number}")
        drop_versions(spark, f"{path}/next", number)

    return run


def file_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _number) of all files that ``numbered_batches`` has taken."""
    return spark.read.schema("_file string, _number long, batch int").parquet(f"{path}/files").select("_file", "_number")


def update_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of numbered updates: a table under ``path``, a folder a batch, which ``stream_updates`` follows."""
    return lambda updates, number: updates.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")


def stream_updates(spark: SparkSession, path: str, late: str = "10 minutes", max_files: int = 100) -> DataFrame:
    """A stream of numbered updates from the table that ``update_batches`` writes, with a watermark: rows later than
    ``late`` may be dropped by stateful operators."""
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", max_files).parquet(path).drop("batch").withWatermark("event_ts", late)


def kafka_updates(spark: SparkSession, servers: str, topic: str, late: str = "10 minutes", max_offsets: int = 1_000_000) -> DataFrame:
    """A stream of updates from a topic; ids are made of partition and offset, so a replay gives the same."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    named = source.select(F.col("value").cast("string").alias("value"), (F.shiftleft(F.col("partition").cast("bigint"), 44) + F.col("offset")).alias("msg_id"))
    return to_updates(parse_frames(named)).withWatermark("event_ts", late)


__all__ = [
    "as_number", "file_lines", "file_numbers", "frame_counts", "kafka_updates", "numbered_batches", "parse_frames", "read_updates", "split_frames",
    "stream_frames", "stream_updates", "to_updates", "update_batches", "with_line_numbers",
]
