"""Ranked lexical search without an index of the documents: one automaton of all items' terms, each with a guard on
either side, runs over every text and counts; its outputs lead to the items that hold the term.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z alone are lower-cased. All sums are
64-bit integers, weights are floored from doubles.

Contract for odd input: a null or empty text has no term and is no document of the statistics; rows that repeat an id
are documents of their own, so an id may be ranked twice; long texts are scanned whole; equal scores are ranked by
ascending id, null ids last; rows that repeat an item's id unite their terms, an item without terms or hits has no row;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from asnwatch.llm.common import checkpointed, map_texts
from asnwatch.llm.licenses import word_table

TOP = 50
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Terms of the items that one automaton holds, about; more items take further scans. A single item may have more.
LOT_TERMS = 200_000
#: Scores that a task works out at a time, and (item, document) candidates that it gathers before it keeps the best.
BLOCK = 1 << 21
POOL = 1 << 18


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    lowered = F.translate(F.col(text_column), _UPPER, _UPPER.lower())
    return items.select(F.col(id_column).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))).alias("term")).distinct()


def guarded(terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of " term " with the term's number as output."""
    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def count_terms(docs: DataFrame, terms: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each document: id, n (its terms with repeats), and of those among ``terms`` number and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    second = itemgetter(1)

    def make():
        table, machine = word_table(), guarded(sent.value) if sent.value else None

        def each(batch: pa.RecordBatch) -> dict:
            n, numbers, times, sizes = [], [], [], []
            for raw in batch.column(text_column).cast(pa.binary()).to_pylist():
                spaced = b" %s " % (raw or b"")
                spaced = spaced.translate(table)
                inside = np.frombuffer(spaced, np.uint8) != 0x20
                n.append(int(np.count_nonzero(inside[1:] > inside[:-1])))
                found = Counter(map(second, machine.iter(spaced.decode()))) if machine and n[-1] else {}
                numbers.append(np.fromiter(found.keys(), np.int32, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
                sizes.append(len(found))
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = {name: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, kind), *parts]))) for name, parts, kind in (("terms", numbers, np.int32), ("tf", times, np.int64))}
            return {id_column: batch.column(id_column), "n": n} | lists

        return each

    kept = docs.select(id_column, text_column)
    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, n long, terms array<int>, tf array<long>", text_column)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``top`` best (score, id) of each item among all that were offered."""

    def __init__(self, n_items: int, top: int):
        self.top, self.pool, self.size = top, [], 0
        self.least = np.ones(n_items, np.int64)  # what a document must score to be looked at

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of documents (rows) for items (columns)."""
        row, item = np.nonzero(scores >= self.least)
        self.pool.append(pa.table({"item": item.astype(np.int32), "score": scores[row, item], "id": ids.take(pa.array(row))}))
        self.size += len(row)
        if self.size > max(POOL, 4 * self.top * len(self.least)):
            self.pool, self.size = [self.best()], 0

    def best(self) -> pa.Table:
        every = pa.concat_tables(self.pool)
        every = every.take(pa.compute.sort_indices(every, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        item = every["item"].to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.least[item[last]] = every["score"].to_numpy()[last]
        return every.filter(pa.array(place < self.top)).combine_chunks()


def block_scores(terms: np.ndarray, tf: np.ndarray, row: np.ndarray, m: np.ndarray, weights: np.ndarray, first: np.ndarray, members: np.ndarray, n_items: int) -> np.ndarray:
    """Scores of documents for items from the documents' (row, term, tf). The items of term t are members[first[t]:first[t + 1]]."""
    gain = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    held = first[terms + 1] - first[terms]
    before = np.cumsum(held) - held
    item = members[np.repeat(first[terms] - before, held) + np.arange(held.sum())]
    out = np.zeros(len(m) * n_items, np.int64)
    np.add.at(out, np.repeat(row, held) * n_items + item, np.repeat(gain, held))
    return out.reshape(len(m), n_items)


def _lot(docs: DataFrame, pairs: DataFrame, top: int, id_column: str, text_column: str) -> DataFrame:
    """Ranked documents of one lot of items, whose terms fit an automaton."""
    spark = docs.sparkSession
    item_type, id_type = pairs.schema["item_id"].dataType, docs.schema[id_column].dataType
    held = pairs.collect()  # about LOT_TERMS rows
    terms = sorted({r["term"] for r in held})
    ids = list(dict.fromkeys(r["item_id"] for r in held))
    number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
    counts = checkpointed(count_terms(docs, terms, id_column, text_column))
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    out = f"item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long"
    if not held or not total["docs"]:
        return spark.createDataFrame([], out)
    n_docs, n_terms = int(total["docs"]), int(total["terms"])
    df = {r["term"]: r["df"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term of the lot
    of_term = sorted((number[r["term"]], place[r["item_id"]]) for r in held)
    model = {
        "weights": np.array([weight(n_docs, df.get(i, 0)) for i in range(len(terms))], np.int64),
        "first": np.searchsorted(np.array([x for x, _ in of_term], np.int64), np.arange(len(terms) + 1)),
        "members": np.array([x for _, x in of_term], np.int64),
        "n_items": len(ids),
    }
    sent = spark.sparkContext.broadcast((model, ids))
    item_kind, id_kind = to_arrow_type(item_type), to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = sent.value
        best = Best(len(ids), top)
        step = max(1, BLOCK // len(ids))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes = pa.compute.list_value_length(part.column("terms")).to_numpy()
                found, tf = part.column("terms").flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                m = 50 + (50 * part.column("n").to_numpy() * n_docs) // n_terms
                best.offer(block_scores(found, tf, np.repeat(np.arange(len(m)), sizes), m, **model), part.column(id_column))
        if best.pool:
            rows = best.best()
            items = pa.array(ids, item_kind).take(rows["item"].combine_chunks())
            columns = [items, rows["id"].combine_chunks().cast(id_kind), rows["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["item_id", "doc_id", "score"])

    return counts.filter("n > 0").mapInArrow(run, out)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of each item: item_id, rank from 1, doc_id, score. Texts are scanned once for each
    LOT_TERMS terms of the items. Every task hands on its own best of each item alone."""
    pairs = item_terms(items, item_column, item_text)
    n_lots = max(1, -(-pairs.count() // LOT_TERMS))
    lot = F.pmod(F.xxhash64("item_id"), F.lit(n_lots))
    found = None
    for k in range(n_lots):
        part = _lot(docs, pairs.filter(lot == k) if n_lots > 1 else pairs, top, id_column, text_column)
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id"), "score")
