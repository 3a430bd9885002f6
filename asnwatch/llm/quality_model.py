"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics,
partition-summed normal equations fit ridge scores, isotonic regression calibrates them.

Contract for odd input: a null or empty text has statistics 0 and is scored like any other; rows
without a label are not learned from; repeated rows are scored alike; of labelled rows that repeat an id one
teaches, the one with the smallest statistics; of labels that repeat an id the largest holds; long texts are taken
whole; without training rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, ddl, hash_fraction, map_texts, sample_to, texts_of

#: Labelled texts that the fit reads, about, at most.
SAMPLE = 20_000
SHARDS = 8
FEATURES = 192
#: Width of the kernel: the scale of the random frequencies, for standardised statistics.
SCALE = 0.35
RIDGE = 1.0
#: Raw scores are counted in so many bins for the calibration, which uses one sampled text of CALIBRATION.
BINS = 400
CALIBRATION = 4
#: Share of the raw score in the result; it orders texts that the calibration holds equal.
TIE_BREAK = 0.01
SEED = 5
#: Bytes of text taken at a time.
SLICE = 2 << 20

_UPPER = bytes(range(0x41, 0x5B))
_GROUPS = {"upper": _UPPER, "digit": b"0123456789", "symbol": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:", "bracket": b"()[]{}\"'", "high": bytes(range(0x80, 0x100))}
_DELETE = {k: bytes(c for c in range(256) if c not in v) for k, v in _GROUPS.items()}
STATISTICS = ("log_words", "word_length", *_GROUPS, "stutter", "distinct", "lines", "dup_lines", "longest", "short", "cased")


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for one text; rates are per byte, per word or per line."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lengths = list(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        sum(lengths) / n,
        *(len(raw.translate(None, d)) / size for d in _DELETE.values()),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        len(lines) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        float(np.log1p(max(lengths, default=0))),
        sum(x < 4 for x in lengths) / n,
        sum(map(bytes.isupper, words)) / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, random frequencies, ridge weights and the calibration's knots; fixed size."""

    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels)
        return level * (1 - TIE_BREAK) + np.clip(raw, 0, 1) * TIE_BREAK


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of least weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Fit on texts whose id ``labels`` has, about ``sample`` of them at most, drawn by a hash of the id.
    SHARDS tasks sum the normal equations of their rows; the driver adds the sums and solves."""
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("label"))
    chosen = sample_to(known, sample, id_column)
    width = len(STATISTICS)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            return {id_column: batch.column(id_column), "label": batch.column("label"), "stats": [statistics(t) for t in texts_of(batch, text_column)]}

        return each

    id_type = docs.schema[id_column].dataType.simpleString()
    joined = docs.select(id_column, text_column).join(F.broadcast(chosen), id_column)  # at most about `sample` ids
    each_id = map_texts(joined, make, f"{id_column} {id_type}, label int, stats array<double>", text_column, SLICE).groupBy(id_column, "label").agg(F.min("stats").alias("stats"))
    rows = checkpointed(each_id.coalesce(SHARDS))
    rows = rows.withColumn("calibrates", F.floor(hash_fraction(id_column) * 1_000_003) % CALIBRATION == 0)
    moments = rows.select(*[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    frequencies, phases = rng.normal(0, SCALE, (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    mean, deviation = (np.array([moments[f"{f}{i}"] if moments[f"{f}{i}"] is not None else 0.0 for i in range(width)]) for f in ("avg", "stddev_pop"))
    model = QualityModel(mean, np.where(deviation > 1e-9, deviation, 1.0), frequencies, phases, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    if moments["avg0"] is None:
        return model

    def read_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, width), batch.column("label").to_numpy().astype(float)

    def equations(batches):
        left, right, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            x, y = read_batch(batch)
            x = model.features(x)
            left, right, n = left + x.T @ x, right + x.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (left, right)], names=["left", "right"])

    parts = rows.filter(~F.col("calibrates")).mapInArrow(equations, "left binary, right binary").toArrow().to_pylist()  # one row of fixed size a shard
    if not parts:
        return model
    left = sum(np.frombuffer(p["left"]) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(left + penalty, sum(np.frombuffer(p["right"]) for p in parts))
    model = QualityModel(model.mean, model.deviation, frequencies, phases, weights, np.zeros(0), np.zeros(0))

    def binned(batches):
        for batch in batches:
            x, y = read_batch(batch)
            at = np.floor(np.clip(model.raw(x), -0.5, 1.5) * BINS / 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])

    held = rows.filter("calibrates").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not held:
        held = [{"bin": 0, "y": 0.0, "n": 1}, {"bin": BINS // 2, "y": 1.0, "n": 1}]
    knots = np.array([(r["bin"] + 0.5) * 2 / BINS for r in held])
    levels = isotonic(np.array([r["y"] for r in held]), np.array([float(r["n"]) for r in held]))
    return QualityModel(model.mean, model.deviation, frequencies, phases, weights, knots, levels)


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: id, the columns ``carry`` and the calibrated score from 0 to 1. A map over rows, the model broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*dict.fromkeys([id_column, text_column, *carry]))

    def make():
        model = sent.value

        def each(batch: pa.RecordBatch) -> dict:
            stats = np.array([statistics(t) for t in texts_of(batch, text_column)], float).reshape(batch.num_rows, len(STATISTICS))
            return {c: batch.column(c) for c in out} | {"score": model.score(stats)}

        return each

    out = list(dict.fromkeys([id_column, *carry]))
    return map_texts(kept, make, f"{ddl(kept, out)}, score double", text_column, SLICE)
