"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure bit and the
measurements are stored, and versioned policies and ablations read the ledger only.

Contract for odd input: a null or empty text has no words, all measurements 0, and fails
``too_few_words``; repeated rows get equal entries; long texts are measured whole; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import map_texts, texts_of

#: Words of the windows that count as repeated.
WINDOW = 8
_UPPER = bytes(range(0x41, 0x5B))
_NOT_UPPER = bytes(c for c in range(256) if c not in _UPPER)
_NOT_LETTER = bytes(c for c in range(128) if not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))
_NOT_SHOUT = bytes(c for c in range(256) if c not in b"!?")
_NOT_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
_SYMBOLS = "#*$%&|<>"
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_bytes long, n_upper long, n_letters long, n_shouts long, n_digits long, longest_word long, n_stutters long"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    order = np.argsort(rolled, kind="stable")
    same = np.diff(rolled[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    places = np.flatnonzero(twice).tolist()
    for i in places:  # equal codes are checked against the words themselves
        key = tuple(words[i : i + window])
        seen[key] = seen.get(key, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for i in places:
        if seen[tuple(words[i : i + window])] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measurements(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of measurements for each row of ``docs``; a map over rows, no shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in texts_of(batch, text_column):
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
                rows.append((
                    len(words),
                    len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
                    sum(map(text.count, _SYMBOLS)),
                    len(lines) - len(set(lines)),
                    repeated_words(words),
                    len(lines),
                    len(raw),
                    len(raw.translate(None, _NOT_UPPER)),
                    len(raw.translate(None, _NOT_LETTER)),
                    len(raw.translate(None, _NOT_SHOUT)),
                    len(raw.translate(None, _NOT_DIGIT)),
                    max(map(len, words), default=0),
                    sum(map(eq, words, words[1:])),
                ))
            columns = np.array(rows, np.int64).reshape(len(rows), -1).T
            return {id_column: batch.column(id_column)} | dict(zip((x.split()[0] for x in _SCHEMA.split(", ")), columns, strict=False))

        return each

    kept = docs.select(id_column, text_column)
    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, {_SCHEMA}", text_column)


def rules() -> dict[str, Column]:
    """Failure conditions over the measurements by name; the place in this table is the bit, so
    rules are only ever appended."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "too_few_words": F.col("n_words") < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": F.col("n_symbols") > 0.1 * words,
        "duplicate_lines": (F.col("n_dup_lines") >= 4) & (F.col("n_dup_lines") > 0.5 * F.col("n_lines")),
        "upper_case": F.col("n_upper") > 0.5 * F.greatest(F.col("n_letters"), F.lit(1)),
        "shouting": F.col("n_shouts") > 0.1 * words,
        "word_length": (F.col("word_chars") < 2.5 * words) | (F.col("word_chars") > 15 * words),
        "long_word": F.col("longest_word") > 1000,
        "digits": F.col("n_digits") > 0.3 * F.greatest(F.col("n_bytes"), F.lit(1)),
        "stutter": F.col("n_stutters") > 0.2 * words,
    }


@dataclass(frozen=True)
class Policy:
    """A version of the rules that a corpus must pass."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        places = list(rules())
        return sum(1 << places.index(r) for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
DEFAULT = Policy("web", 1, ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "shouting", "word_length", "long_word", "digits", "stutter"))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, id_column, text_column).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``kept``, ``policy`` and ``policy_version``; nothing is measured again."""
    return entries.withColumns({
        "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0,
        "policy": F.lit(policy.name),
        "policy_version": F.lit(policy.version),
    })


def ablations(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: how many rows fail it, how many fail it alone (and would be kept
    without it), and how many the policy keeps. One aggregation over at most 2**rules bit patterns."""
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    places = list(rules())
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << places.index(r)).cast("long").alias("bit")) for r in policy.rules])
    return (
        patterns.select("bits", "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
