"""Token ids in directly addressable codes: each id is split into chunks of eight bits, the chunks of one place form a
level, and a bitmap tells of which codes a further chunk stands in the next level. The number of set bits before a place,
kept in a rank directory, is the place in the next level, so that any token is read without those before it.

The file format is a Parquet table of segments of about SEGMENT ids: (part, nth, before, n_tokens, ids, ends, payload). Parts
and their segments are numbered in ascending order of document ids, ``before`` counts the part's ids in earlier segments, ``ids`` and
``ends`` are the documents of a segment and where they end in it, and ``payload`` holds the codes (see ``encode``).

Contract for odd input: a null or empty text is the end id alone; null document ids come first; rows that repeat
an id stay apart, in the order in which they are read; long texts are encoded whole and lie in one segment; an empty
table gives a folder without segments, from which no rows are read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from asnwatch.llm.common import _held, held, release, slices
from asnwatch.llm.packing import _runs

END = 0
SEGMENT = 1 << 18
#: Bits that one entry of a rank directory stands for.
RANKED = 512
MAGIC = b"DAC1"
#: Stands between the pieces of a text; no plain character.
CUT = "\x02"
#: Pieces whose ids a worker remembers, pieces learned at a time, and bytes of text taken at a time.
REMEMBERED = 1_000_000
LESSON = 40_000
SLICE = 4 << 20


def encode(ids: np.ndarray) -> bytes:
    """MAGIC, the number of levels, and for each level: its number of codes, the codes (a byte each), and unless it is the
    last one the bitmap (lowest bit first) and its rank directory of 32-bit counts. Numbers are little-endian."""
    left, levels = np.asarray(ids, np.uint32), []
    while True:
        more = left > 0xFF
        last = not more.any()
        level = struct.pack("<Q", len(left)) + left.astype(np.uint8).tobytes()
        if not last:
            bits = np.packbits(more, bitorder="little")
            set_before = np.append(0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANKED), dtype=np.uint32))[:-1])
            level += bits.tobytes() + set_before.astype("<u4").tobytes()
        levels.append(level)
        if last:
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        left = left[more] >> 8


class Codes:
    """The ids of a payload, read where they lie."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a payload of token codes")
        n_levels, at = struct.unpack_from("<I", payload, 4)[0], 8
        self.levels = []
        for k in range(n_levels):
            n, at = struct.unpack_from("<Q", payload, at)[0], at + 8
            codes, at = np.frombuffer(payload, np.uint8, n, at), at + n
            bits = ranks = None
            if k < n_levels - 1:
                size = -(-n // 8)
                bits, at = np.frombuffer(payload, np.uint8, size, at), at + size
                size = -(-n // RANKED)
                ranks, at = np.frombuffer(payload, "<u4", size, at), at + 4 * size
            self.levels.append((codes, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, place: int) -> int:
        """Set bits before ``place``: those counted in the directory and those of at most RANKED bits more."""
        codes, bits, ranks = self.levels[level]
        if place >= len(codes):
            return len(self.levels[level + 1][0])
        start = place - place % RANKED
        return int(ranks[place // RANKED]) + int(np.unpackbits(bits[start // 8 : -(-place // 8)], bitorder="little")[: place - start].sum())

    def _part(self, level: int, start: int, stop: int) -> np.ndarray:
        codes, bits, _ = self.levels[level]
        out = codes[start:stop].astype(np.uint32)
        if bits is not None and stop > start:
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            out[more] |= self._part(level + 1, self._rank(level, start), self._rank(level, stop)) << 8
        return out

    def part(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, which touches their codes alone."""
        return self._part(0, max(start, 0), min(stop, len(self)))

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        value, shift = 0, 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= int(codes[place]) << shift
            if bits is None or not bits[place >> 3] >> (place & 7) & 1:
                break
            place, shift = self._rank(level, place), shift + 8
        return value


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer, each distinct piece of a text encoded once: a run of letters with the space or
    white space before it, or what stands between such runs. No word and no white space that the tokenizer tells apart
    reaches over such a cut.

    Cutting happens here only for texts of plain characters in which it cannot differ from the tokenizer's own; all
    others are given to it whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread; Spark runs them side by side
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        plain = [c for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)) if c != 0xAD]
        letters = _ranges([c for c in plain if unicodedata.category(chr(c))[0] == "L"])
        blank = r"\t\n\r "
        # Further: apostrophes next to other signs, and runs of white space of which a space in the middle, or at the end
        # of the text, belongs to two pieces.
        self.odd = rf"[^{_ranges(plain)}]|<\||[^{letters}{blank}]'|'[^{letters}{blank}]|[{blank}] [{blank}]|[{blank}] \z"
        self.between = rf"([{blank}]*[^{letters}'{blank}]+)"
        self.forget()

    def forget(self) -> None:
        self.known = {"": 0}
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces not known yet."""
        for start in range(0, len(pieces), LESSON):
            part = pieces[start : start + LESSON]
            found = [x.ids for x in self.model.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int32, len(found))
            self.known.update(zip(part, range(len(self.size), len(self.size) + len(part)), strict=True))
            self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pa.compute.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(odd).tolist()
        whole = dict(zip(at, self.model.encode_batch_fast([texts[i].as_py() for i in at], add_special_tokens=False), strict=True))
        if at:
            texts = pa.compute.if_else(pa.array(odd), "", texts)
        cut = pa.compute.replace_substring(pa.compute.replace_substring_regex(texts, self.between, rf"{CUT}\1{CUT}"), " ", f"{CUT} ")
        lists = pa.compute.split_pattern(cut, CUT)
        pieces = lists.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([w for w in words if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[pieces.indices.to_numpy()]
        size = self.size[number]
        ids = self.ids[_runs(self.first[number], size)]
        counts = pa.compute.list_value_length(lists).to_numpy()
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.cumsum(counts)]
        starts = np.append(0, ends)[:-1]
        return [np.array(whole[i].ids, np.uint32) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    first = [c for c in codes if c - 1 not in codes]
    last = [c for c in codes if c + 1 not in codes]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(sorted(first), sorted(last), strict=True))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_folder(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir has its own, which all executors share; on one machine it may be a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.gettempdir()
    return f"{base}/tokens-{uuid.uuid4()}"


def segments(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", size: int = SEGMENT, end: int = END) -> DataFrame:
    """The rows of the file format. Texts are dealt out and sorted by id before they are encoded; rows of one id are told
    apart by where they were read, so that they too are spread."""
    path, kind = tokenizer or tokenizer_path(), docs.schema[id_column].dataType
    kept = docs.select(id_column, text_column, F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first(id_column), F.col("_row")]
    dealt = kept.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    id_kind = to_arrow_type(kind)
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(id_kind)), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
    name = f"byte tokenizer {path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _held:
            _held.clear()
        model = held(name, lambda: ByteTokenizer(path))
        part, nth, before = TaskContext.get().partitionId(), 0, 0
        ids, lots, total = [], [], 0

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in lots])
            row = [part, nth, before, total, pa.concat_arrays(ids).to_pylist(), ends, encode(np.concatenate(lots))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for piece in slices(batch, text_column, SLICE):
                texts = model.encode(pa.compute.fill_null(piece.column(text_column), ""))
                start = 0
                for i, found in enumerate(texts):
                    lots.append(np.append(found, np.uint32(end)))
                    total += len(lots[-1])
                    if total >= size:
                        ids.append(piece.column(id_column).slice(start, i + 1 - start))
                        yield segment()
                        nth, before, start = nth + 1, before + total, i + 1
                        ids, lots, total = [], [], 0
                if start < len(texts):
                    ids.append(piece.column(id_column).slice(start))
        if lots:
            yield segment()
        release()

    return dealt.mapInArrow(run, f"part int, nth int, before long, n_tokens long, ids array<{kind.simpleString()}>, ends array<long>, payload binary")


def write_documents(docs: DataFrame, path: str, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", size: int = SEGMENT, end: int = END) -> None:
    """Encode all documents into the file format under ``path``, which must not be there yet."""
    segments(docs, tokenizer, id_column, text_column, size, end).write.parquet(path)


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all documents before them. What is sent to all tasks is a row for each part,
    that is for each task that wrote."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opening = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("opening"))
    return rows.join(F.broadcast(opening), "part").withColumn("start", F.col("opening") + F.col("before")).drop("opening")


def read_documents(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Of each document in the files: its id, start, n_tokens and ids_crc32, worked out from the codes."""
    rows = with_starts(spark, path)
    kind = rows.schema["ids"].dataType.elementType
    id_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                found = Codes(row["payload"].as_py())
                ids = found.part(0, len(found)).astype("<u4", copy=False)
                ends = row["ends"].values.to_numpy()
                starts = np.append(0, ends)[:-1]
                crc = [crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [row["ids"].values.cast(id_kind), pa.array(starts + row["start"].as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "n_tokens", "ids_crc32"])

    return rows.select("start", "ids", "ends", "payload").mapInArrow(run, f"{id_column} {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """(position, token) for the places asked for, counted over all files; places beyond them have no row. Segments are found
    by equality joins on spans of places, and only segments that are asked for are read, at those places alone."""
    wide = 1 << 20
    found = with_starts(spark, path)
    spans = found.select("part", "nth", "start", "n_tokens", F.explode(F.sequence(F.expr(f"start div {wide}L"), F.expr(f"(start + n_tokens - 1) div {wide}L"))).alias("span"))
    asked = positions.select(F.col(column).cast("bigint").alias("position")).distinct().withColumn("span", F.expr(f"position div {wide}L"))
    hits = asked.join(spans, "span").filter("position >= start and position < start + n_tokens")
    wanted = hits.groupBy("part", "nth", "start").agg(F.collect_list("position").alias("positions"))  # a segment's places at most
    rows = wanted.join(spark.read.parquet(path).select("part", "nth", "payload"), ["part", "nth"]).select("start", "positions", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, places, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "positions", "payload")), strict=True):
                codes = Codes(payload)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([codes[p - start] for p in places], pa.int64())], names=["position", "token"])

    return rows.mapInArrow(run, "position long, token long")
