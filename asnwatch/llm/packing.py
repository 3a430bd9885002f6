"""Best-fit packing by exact complements: token sequences of a fixed capacity are filled from a histogram
of piece lengths, gaps first with one, two or three lengths that fill them exactly, the rest by best fit.

The plan is made from the histogram alone (at most ``capacity`` numbers, however many documents), and
every piece finds its place by the rank that it has among the pieces of its length.

Contract for odd input: a null or empty text is the end mark alone, a piece of length 1; repeated rows
are packed each for itself; long texts are encoded whole and cut into pieces; pieces of equal length are placed
in the order of their tasks; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, held, map_texts

CAPACITY = 4096
END = 1
#: Chunks (words with what clings to them) whose ids a worker remembers, words encoded in one call, and bytes of text taken at a time.
REMEMBERED = 400_000
AT_ONCE = 2_000
SLICE = 2 << 20
#: Chunks that are learned at a time.
LESSON = 40_000
_RANK_BITS = 44


class CachedTokenizer:
    """Ids of a word-wise BPE tokenizer (lower case, white space dropped), each distinct chunk of a text between
    white space encoded once. Chunks are split, told apart and looked up as Arrow arrays.

    Splitting happens here only for texts of plain characters, where it cannot differ from the
    tokenizer's own; all others are given to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        plain = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)) if c not in (0xAD, 0x130)]
        kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k and c == c.lower())
        self.odd = f"[^{''.join(map(re.escape, plain))}]|<\\|"
        letters, numbers = kind("L"), kind("N")
        self.word = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        # The same model for words that are split already; its words' last tokens are marked.
        self.words = Tokenizer(self.model.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.model.model.end_of_word_suffix
        self.ends = np.zeros(max(self.model.get_vocab().values(), default=0) + 1, bool)
        self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""], pa.string())  # the empty chunk has no ids
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, chunks: pa.Array) -> None:
        """Remember the ids of chunks not known yet."""
        words = [self.word.findall(c) for c in chunks.to_pylist()]
        fresh = list(dict.fromkeys(w for each in words for w in each))
        lots = self.words.encode_batch_fast([" ".join(fresh[i : i + AT_ONCE]) for i in range(0, len(fresh), AT_ONCE)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(x.ids, np.uint32) for x in lots]])
        stop = np.flatnonzero(self.ends[ids]) + 1
        start = np.append(0, stop)[:-1]
        number = dict(zip(fresh, range(len(fresh)), strict=True))
        which = np.fromiter((number[w] for each in words for w in each), np.int64)
        size = (stop - start)[which]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = np.append(0, np.cumsum(size))
        ends = total[np.cumsum(counts)]
        sizes = np.diff(np.append(0, ends))
        self.first = np.append(self.first, len(self.ids) + ends - sizes)
        self.size = np.append(self.size, sizes)
        self.ids = np.append(self.ids, ids[_runs(start[which], size)])
        self.known = pa.concat_arrays([self.known, chunks])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pa.compute.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(odd).tolist()
        whole = dict(zip(at, self.model.encode_batch_fast([texts[i].as_py() for i in at], add_special_tokens=False), strict=True))
        if at:
            texts = pa.compute.if_else(pa.array(odd), "", texts)
        lists = pa.compute.utf8_split_whitespace(pa.compute.utf8_lower(texts))
        chunks = lists.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.forget()
        found = pa.compute.index_in(chunks.dictionary, self.known)
        if found.null_count:
            fresh = chunks.dictionary.filter(found.is_null())
            for start in range(0, len(fresh), LESSON):
                self.learn(fresh.slice(start, LESSON))
            found = pa.compute.index_in(chunks.dictionary, self.known)
        number = found.to_numpy()[chunks.indices.to_numpy()]
        size = self.size[number]
        ids = self.ids[_runs(self.first[number], size)]
        counts = pa.compute.list_value_length(lists).to_numpy()
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        starts = np.append(0, ends)[:-1]
        return [np.array(whole[i].ids, np.uint32) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one run after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of each row of ``docs``: id, piece, start, length, ids_crc32, and where the
    piece is counted: task and nth, its number among the task's pieces of that length."""
    path = tokenizer or tokenizer_path()
    kept = docs.select(id_column, text_column)

    def make():
        model = held(f"tokenizer {path}", lambda: CachedTokenizer(path))
        task = TaskContext.get().partitionId()
        counted = np.zeros(capacity + 1, np.int64)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("piece", "start", "length", "ids_crc32", "nth")}
            row = []
            for i, ids in enumerate(model.encode(pa.compute.fill_null(batch.column(text_column), ""))):
                ids = np.append(ids, np.uint32(END)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row.append(i)
                    for n, v in zip(out, (piece, start, len(part), crc32(part.tobytes()), int(counted[len(part)])), strict=True):
                        out[n].append(v)
                    counted[len(part)] += 1
            return {id_column: batch.column(id_column).take(pa.array(row, pa.int64())), "task": np.full(len(row), task)} | out

        return each

    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long, task int, nth long", text_column, SLICE, f"tokenizer {path}")


class SumIndex:
    """For every total, lengths in stock that sum to it: one, a pair, or three. Pairs are hashed by their sum with
    one part each, triples with their largest part; what has run out of stock since is looked for anew, and a
    sum without an entry has none, as stock only shrinks."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pair, self.triple = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        stock = np.flatnonzero(counts)
        for low in stock[::-1].tolist():  # the smallest part stays
            sums = low + stock[stock > low - (counts[low] > 1)]
            self.pair[sums[sums < len(counts)]] = low
        twos = np.flatnonzero(self.pair)
        for high in stock.tolist():  # the largest part stays
            sums = high + twos
            self.triple[sums[sums < len(counts)]] = high

    def _pair(self, total: int) -> tuple[int, int] | None:
        low, counts = int(self.pair[total]), self.counts
        if low and counts[low] > (2 * low == total) and counts[total - low] > 0:
            return total - low, low
        half = total // 2
        both = np.flatnonzero((counts[1 : half + 1] > 0) & (counts[total - 1 : total - half - 1 : -1] > 0)) + 1 if low else ()
        return next(((total - x, x) for x in map(int, both[:2]) if 2 * x != total or counts[x] > 1), None)

    def _with(self, high: int, total: int) -> tuple[int, ...] | None:
        if not self.counts[high]:
            return None
        self.counts[high] -= 1
        rest = self._pair(total - high)
        self.counts[high] += 1
        return (high, *rest) if rest else None

    def find(self, total: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that sum to ``total``, the largest first of one or two."""
        if self.counts[total] > 0:
            return (total,)
        if two := self._pair(total):
            return two
        high = int(self.triple[total])
        if not high:
            return None
        if three := self._with(high, total):
            return three
        least = -(-total // 3)  # the largest of three is a third at least
        stock = least + np.flatnonzero(self.counts[least:total])
        for high in stock[self.pair[total - stock] > 0][::-1].tolist():
            if three := self._with(high, total):
                self.triple[total] = high
                return three
        return None


def packing_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use every counted piece once. Each entry
    uses up a length or all but a remainder of it, so the plan's size depends on ``capacity`` only."""
    counts = np.asarray(histogram, np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((counts[kinds] // times).min())
        counts[kinds] -= n * times
        plan.append((lengths, n))

    index = SumIndex(counts)
    for length in range(capacity, 0, -1):  # exact fillings
        while counts[length] > 0:
            counts[length] -= 1
            rest = () if length == capacity else index.find(capacity - length)
            counts[length] += 1
            if rest is None:
                break
            use((length, *rest))
    while counts.any():  # best fit of what is left
        length = int(np.flatnonzero(counts)[-1])
        lengths, gap = [length], capacity - length
        counts[length] -= 1
        taken = [length]
        while gap > 0 and len(fits := np.flatnonzero(counts[: gap + 1])):
            best = int(fits[-1])
            lengths.append(best)
            taken.append(best)
            counts[best] -= 1
            gap -= best
        for x in taken:
            counts[x] += 1
        use(tuple(lengths))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: pieces of ``length`` with ranks from ``rank`` on lie in the sequences
    from ``sequence`` on, at ``offset``. Sorted by key, which is length and rank."""
    key, sequence, offset = [], [], []
    used, first = [0] * (capacity + 1), 0
    for lengths, n in plan:
        place = 0
        for length in lengths:
            key.append(length << _RANK_BITS | used[length])
            sequence.append(first)
            offset.append(place)
            used[length] += n
            place += length
        first += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in (("key", key), ("sequence", sequence), ("offset", offset))}


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """The pieces of ``token_pieces`` with sequence_id and offset."""
    pieces = checkpointed(pieces)  # tokens are counted once, and tasks keep their numbers
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    sent = pieces.sparkSession.sparkContext.broadcast(slots(packing_plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = [id_column, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        table = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            wanted = length << _RANK_BITS | rank
            at = np.searchsorted(table["key"], wanted, side="right") - 1
            place = [table["sequence"][at] + wanted - table["key"][at], table["offset"][at]] if len(at) else [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns[:3]] + [pa.array(length), b.column("ids_crc32")] + [pa.array(x) for x in place], names=[*columns, "sequence_id", "offset"])

    id_type = pieces.schema[id_column].dataType.simpleString()
    return ranked.select(*columns, "rank").mapInArrow(run, f"{id_column} {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
