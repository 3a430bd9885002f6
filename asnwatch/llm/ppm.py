"""Language-model scores by prediction by partial matching over bytes, and by word counts.

The model is a trie of byte contexts up to ORDER. A symbol unseen in a context escapes to the next
shorter one (method C: as often as the context has distinct symbols), and symbols of the longer
contexts are excluded there. Below the empty context all remaining bytes are equally likely.
A text is its UTF-8 bytes and an end mark; an empty text is the end mark alone.

Contract for odd input: a null or empty text has no words and one symbol, its end; rows with a null id are scored but never learned from; repeated rows are scored and
learned from as often as they occur; long texts are coded whole; equally frequent contexts and words are all
broadcast or all joined, with the same result; without training rows every byte is equally likely; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, largest, map_texts, texts_of

ORDER = 3
#: The end mark, a byte that UTF-8 never has; also what stands before a text.
EDGE = 0xFF
#: Contexts of each order in the broadcast table, at most: all shorter ones and the most frequent of the longest.
#: Symbols in any other context that was seen are joined by it.
CONTEXTS = (1, 256, 65_536, 65_536)
#: Words whose counts are broadcast: so many of at most that length in bytes, and so many longer ones of at most that; all others are joined.
FREQUENT, FREQUENT_BYTES = 65_536, 40
LONG, LONG_BYTES = 256, 65_536
#: Count of every word before any is seen.
PRIOR = 0.1


class ContextTrie:
    """Counts by context; codes single texts, adaptively or as learned so far."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, Counter] = {}

    def learn(self, history: bytes, symbol: int) -> None:
        for n in range(self.order + 1):
            self.counts.setdefault(history[len(history) - n :], Counter())[symbol] += 1

    def probability(self, history: bytes, symbol: int) -> float:
        excluded: set[int] = set()
        scale = 1.0
        for n in range(self.order, -1, -1):
            seen = {s: c for s, c in self.counts.get(history[len(history) - n :], {}).items() if s not in excluded}
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return scale * seen[symbol] / total
            if seen:
                scale *= len(seen) / total
                excluded |= seen.keys()
        return scale / (256 - len(excluded))

    def log10_probability(self, text: str, adaptive: bool = False) -> float:
        """Of a whole text and its end; with ``adaptive``, each symbol is learned after it is coded."""
        raw, score = text.encode("utf-8", "surrogatepass"), 0.0
        history = bytes([EDGE] * self.order)
        for symbol in [*raw, EDGE]:
            score += math.log10(self.probability(history, symbol))
            if adaptive:
                self.learn(history, symbol)
            history = (history + bytes([symbol]))[1:] if self.order else b""
        return score


def byte_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, ORDER edges before each and one edge at the end; the places of the coded
    symbols, and the number of coded symbols of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    edges = bytes([EDGE] * ORDER)
    data = np.frombuffer(b"".join(edges + r + bytes([EDGE]) for r in raw), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.cumsum(sizes + ORDER) - sizes
    coded = np.ones(len(data), bool)
    for n in range(1, ORDER + 1):
        coded[first - n] = False
    return data, np.flatnonzero(coded), sizes


def gram_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, n): every ORDER + 1 bytes of all texts as one number, and how often they occur."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            data, at, _ = byte_rows(texts_of(batch, text_column))
            gram = np.zeros(len(at), np.uint32)
            for n in range(ORDER, -1, -1):
                gram = gram << np.uint32(8) | data[at - n]
            gram, n = np.unique(gram, return_counts=True)
            return {"gram": gram.astype(np.int64), "n": n.astype(np.int64)}

        return each

    return map_texts(docs.select(text_column), make, "gram long, n long", text_column).groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """Sorted contexts of one order, and the counts of the symbols seen in each, from ``first`` on."""

    contexts: np.ndarray
    first: np.ndarray
    symbols: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, n: np.ndarray) -> Counts:
        order = np.argsort(gram)
        contexts, first = np.unique(gram[order] >> 8, return_index=True)
        return Counts(contexts, np.append(first, len(gram)), (gram[order] & 255).astype(np.uint8), n[order])

    def dense(self, contexts: np.ndarray) -> np.ndarray:
        """Counts of all 256 symbols, 0 in contexts never seen."""
        out = np.zeros((len(contexts), 256), np.int64)
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
            sizes = np.where(self.contexts[at] == contexts, self.first[at + 1] - self.first[at], 0)
            which = np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out[np.repeat(np.arange(len(contexts)), sizes), self.symbols[which]] = self.n[which]
        return out


def log_rows(own: np.ndarray, shorter: list[Counts], contexts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """log10 probabilities in ``contexts`` with the counts ``own``, a column for each symbol in use and one for all others."""
    left = np.ones((len(contexts), 256), bool)  # symbols not excluded yet
    scale, out = np.ones((len(contexts), 1)), np.zeros((len(contexts), 256))
    for n in range(len(shorter), -1, -1):
        counts = np.where(left, own if n == len(shorter) else shorter[n].dense(contexts & ((1 << 8 * n) - 1)), 0)
        distinct = (counts > 0).sum(axis=1, keepdims=True)
        total = np.maximum(counts.sum(axis=1, keepdims=True) + distinct, 1)
        out += scale * counts / total
        scale = np.where(distinct > 0, scale * distinct / total, scale)
        left &= counts == 0
    out += left * scale / np.maximum(left.sum(axis=1, keepdims=True), 1)
    out = np.maximum(out, 1e-300)
    never = np.setdiff1d(np.arange(256), used)
    rest = out[:, never[:1]] if len(never) else np.ones((len(contexts), 1))
    return np.log10(np.hstack([out[:, used], rest])).astype(np.float32)


@dataclass(frozen=True)
class ByteModel:
    """log10 probabilities of each symbol in each kept context, all escapes and exclusions worked in.
    Bounded by CONTEXTS times the symbols in use. The contexts seen but not kept are a bit each."""

    symbol: np.ndarray  # number of each byte; the last number stands for all bytes never seen
    bits: int
    row: np.ndarray  # by the numbers of the last ORDER symbols: the row of the longest kept context
    table: np.ndarray
    rare: np.ndarray | None  # bits of the contexts of ORDER bytes that were seen and have no row, if any

    def log10_probability(self, texts: list[str]) -> np.ndarray:
        """Of whole texts, but for their symbols in rare contexts."""
        return self.parts(texts)[0]

    def parts(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The same, and of each symbol in a rare context the number of its text, the context, and its own number."""
        data, at, sizes = byte_rows(texts)
        numbers = self.symbol[data]
        context = np.zeros(len(at), np.int32)
        for n in range(ORDER, 0, -1):
            context = context << self.bits | numbers[at - n]
        value = self.table[self.row[context], numbers[at]]
        apart, long = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.rare is not None:
            long = np.zeros(len(at), np.int64)
            for n in range(ORDER, 0, -1):
                long = long << 8 | data[at - n]
            apart = np.flatnonzero(self.rare[long >> 6] >> (long & 63).astype(np.uint64) & np.uint64(1))
            value[apart] = 0
        out = np.add.reduceat(value, np.cumsum(sizes) - sizes, dtype=np.float64) if len(texts) else np.zeros(0)
        return out, np.repeat(np.arange(len(texts)), sizes)[apart], long[apart], numbers[at][apart]


def _by_context(grams: DataFrame, order: int) -> DataFrame:
    """(context, gram, n) with contexts of ``order`` bytes."""
    counts = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
    return counts.withColumn("context", F.shiftright("gram", 8))


def byte_model(grams: DataFrame) -> ByteModel:
    """Fit on the counts of ``gram_counts``. The driver receives the symbols of the kept contexts only."""
    return fitted(grams)[0]


def fitted(grams: DataFrame) -> tuple[ByteModel, DataFrame | None]:
    """The model and, if not all contexts are in its table, ``rare_rows`` of the others."""
    kept, rare = [], None  # kept by order
    for order, most in enumerate(CONTEXTS):
        counts = _by_context(grams, order)
        if most < 1 << 8 * order:
            most_frequent = largest(counts.groupBy("context").agg(F.sum("n").alias("total")), "total", most).select("context")
            rare = counts.join(most_frequent, "context", "left_anti")
            counts = counts.join(most_frequent, "context", "left_semi")
        got = counts.select("gram", "n").toArrow()
        kept.append(Counts.of(got["gram"].to_numpy(), got["n"].to_numpy()))
    used = np.unique(kept[0].symbols).astype(np.int64)
    symbol = np.full(256, len(used), np.int32)
    symbol[used] = np.arange(len(used))
    width = len(used) + 1
    bits = max(1, int(width - 1).bit_length())

    tables, row, first = [], np.zeros(1, np.int32), 0
    for order in range(ORDER + 1):
        contexts = kept[order].contexts if order else np.zeros(1, np.int64)
        if order:  # one more symbol to the left: as in the shorter context unless the longer one is kept
            row = np.tile(row, 1 << bits)
            place = np.zeros(len(contexts), np.int64)
            for n in range(order):
                place |= symbol[contexts >> 8 * n & 255].astype(np.int64) << bits * n
            row[place] = first + np.arange(len(contexts))
        cuts = [contexts[i : i + 4096] for i in range(0, len(contexts), 4096)]
        tables += [log_rows(kept[order].dense(c), kept[:order], c, used) for c in cuts]
        first += len(contexts)
    bitmap = None
    if rare is not None:
        words = rare.groupBy(F.expr("context div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(context % 64 as int)))").alias("bits")).toArrow()
        if len(words):  # 2^18 at most
            bitmap = np.zeros(1 << 8 * ORDER - 6, np.uint64)
            bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    model = ByteModel(symbol, bits, row, np.vstack(tables).reshape(-1, width), bitmap)
    return model, None if bitmap is None else rare_rows(rare, kept[:ORDER], used)


def rare_key(context: int) -> bytes:
    """Two spaces and the bytes of the context: neither a word nor a text's own key in ``score``."""
    return b"  " + context.to_bytes(ORDER, "big")


def rare_rows(rare: DataFrame, shorter: list[Counts], used: np.ndarray) -> DataFrame:
    """(word, logs): the key of each context of ``rare`` and its row of log10 probabilities, as in a model's table."""
    sent = rare.sparkSession.sparkContext.broadcast((shorter, used))

    def run(batches):
        shorter, used = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                contexts, seen = batch.column("context").to_numpy(), batch.column("seen")
                own = np.zeros((len(contexts), 256), np.int64)
                flat = seen.flatten()
                at = np.repeat(np.arange(len(contexts)), seen.value_lengths().to_numpy())
                own[at, flat.field("gram").to_numpy() & 255] = flat.field("n").to_numpy()
                logs = log_rows(own, shorter, contexts, used)
                ends = np.arange(len(contexts) + 1, dtype=np.int32) * logs.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([rare_key(c) for c in contexts.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(logs.ravel()))], names=["word", "logs"])

    return rare.groupBy("context").agg(F.collect_list(F.struct("gram", "n")).alias("seen")).mapInArrow(run, "word binary, logs array<float>")


def adaptive_score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: id, n_symbols and score, the log10 probability of the text under a model that starts
    empty and learns each symbol after it is coded; code length in bits is -score / log10(2). A map over rows."""
    kept = docs.select(id_column, text_column)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch, text_column)
            return {
                id_column: batch.column(id_column),
                "n_symbols": [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts],
                "score": [ContextTrie().log10_probability(t, adaptive=True) for t in texts],
            }

        return each

    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, n_symbols long, score double", text_column)


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n) over all texts; words are bytes with A-Z lower-cased, the end of each text the empty word."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            counts: Counter = Counter()
            for text in texts_of(batch, text_column):
                counts.update(text.encode("utf-8", "surrogatepass").lower().split())
            counts[b""] += batch.num_rows
            return {"word": list(counts), "n": list(counts.values())}

        return each

    return map_texts(docs.select(text_column), make, "word binary, n long", text_column).groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, learns: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: id, n_tokens, n_known, train_tokens, base_score (log10 probability under
    smoothed word counts) and score (under the byte model). Both models learn from all rows where ``learns``
    holds. Counts of frequent words and rows of frequent contexts
    are broadcast; rare words and contexts, each in few texts, are joined."""
    training = docs.filter(learns)
    counts = checkpointed(word_counts(training, text_column))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    floor = math.log10(size["n"] + PRIOR * (size["v"] + 1))
    short = largest(counts.filter(F.length("word") <= FREQUENT_BYTES), "n", FREQUENT).collect()  # FREQUENT rows at most
    longer = counts.filter((F.length("word") > FREQUENT_BYTES) & (F.length("word") <= LONG_BYTES))
    frequent = {bytes(r["word"]): r["n"] for r in [*short, *largest(longer, "n", LONG).collect()]}  # LONG * LONG_BYTES at most
    model, others = fitted(checkpointed(gram_counts(training, text_column)))
    sent = docs.sparkSession.sparkContext.broadcast((frequent, model))
    kept = docs.select(id_column, text_column)

    def make():
        frequent, model = sent.value
        value = {w: math.log10(c + PRIOR) - floor for w, c in frequent.items()}
        end = value.get(b"", math.log10(PRIOR) - floor)
        task, done = TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch) -> dict:
            nonlocal done
            texts = texts_of(batch, text_column)
            scores, who, context, symbol = model.parts(texts)
            apart, times = np.unique(who.astype(np.int64) << 33 | context << 9 | symbol, return_counts=True)
            row, word, n, ids, tokens, known, base, score = [], [], [], [], [], [], [], []
            for i, text in enumerate(texts):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                rare = Counter(w for w in words if w not in value)
                number = task << 40 | done + i
                # The row of the text itself; its key holds a space, which no word does.
                row.append(number)
                word.append(b" %d" % number)
                n.append(0)
                ids.append(i)
                tokens.append(len(words) + 1)
                known.append(len(words) - rare.total() + (b"" in value))
                base.append(end + sum(value[w] for w in words if w in value))
                score.append(scores[i])
                row += [number] * len(rare)
                word += rare.keys()
                n += rare.values()
                for column in (ids, tokens, known, base, score):
                    column += [None] * len(rare)
            symbols = [None] * len(row) + (apart & 511).tolist()
            row += ((apart >> 33) + (task << 40 | done)).tolist()
            word += map(rare_key, (apart >> 9 & 0xFFFFFF).tolist())
            n += times.tolist()
            for column in (ids, tokens, known, base, score):
                column += [None] * len(apart)
            done += len(texts)
            return {"row": row, "word": word, "n": n, "symbol": symbols, id_column: batch.column(id_column).take(pa.array(ids, pa.int64())), "tokens": tokens, "known": known, "base": base, "score": score}

        return each

    id_type = kept.schema[id_column].dataType.simpleString()
    rows = map_texts(kept, make, f"row long, word binary, n long, symbol int, {id_column} {id_type}, tokens long, known long, base double, score double", text_column)
    table = counts.select("word", F.col("n").alias("count"))
    table = table.withColumn("logs", F.lit(None).cast("array<float>")) if others is None else table.unionByName(others, allowMissingColumns=True)
    found = rows.join(table, "word", "left")
    rare_value = F.when(F.col("symbol").isNull(), F.col("n") * (F.log10(F.coalesce(F.col("count"), F.lit(0)) + PRIOR) - floor))
    return found.groupBy("row").agg(
        F.max(id_column).alias(id_column),
        F.max("tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("count") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", rare_value)).alias("base_score"),
        F.sum(F.coalesce("score", F.col("n") * F.get("logs", F.col("symbol")))).alias("score"),
    ).select(id_column, "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score")
