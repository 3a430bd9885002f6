"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave a short list of (hash, weight) pairs, which is broadcast.

Contract for odd input: a null or empty text has no feature and gets the score of the bias alone;
rows without a label are not learned from; repeated rows are scored alike; of labelled rows that repeat an id
one teaches, the one with the smallest grams; of labels that repeat an id the largest holds; long texts are taken
whole; without training rows every score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, hash_fraction, map_texts, slices, texts_of
from asnwatch.llm.licenses import word_table

#: Labelled texts of each class that the fit reads, about, at most.
SAMPLE_PER_CLASS = 10_000
#: Bytes of their text, about, at most; a single text may be longer.
SAMPLE_BYTES = 64 << 20
SHARDS = 4
EPOCHS = 4
#: Bytes of text whose grams are held at a time.
SLICE = 2 << 20
#: Bytes of grams (four each) whose texts a shard takes in the order of the epoch; slices follow each other as stored.
SHUFFLED = 16 << 20
ALPHA, BETA, L1, L2 = 8.0, 1.0, 3.0, 0.0

_MIX = np.uint64(0x9E3779B97F4A7C15)
_GRAMS = ((0,), (0, 1), (0, 2))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of words, word pairs and pairs that skip a word, and the numbers of their texts."""
    table = word_table()
    words = [t.lower().encode("utf-8", "surrogatepass").translate(table).split() for t in texts]
    sizes = [len(w) for w in words]
    flat = [w for t in words for w in t]
    code = np.fromiter(map(crc32, flat), np.uint64, len(flat))
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes, owners = [], []
    for kind, places in enumerate(_GRAMS):
        n = max(len(code) - places[-1], 0)
        whole = owner[:n] == owner[places[-1] : places[-1] + n]
        h = np.full(n, kind + 1, np.uint64)
        for p in places:
            h = (h ^ code[p : p + n]) * _MIX
            h ^= h >> np.uint64(29)
        hashes.append((h[whole] >> np.uint64(11)).astype(np.uint32))
        owners.append(owner[:n][whole])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes with a weight other than 0, their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def ftrl_pass(rows: list[tuple], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (feature numbers, label, weight) and, if some features stand for several, how many each
    stands for; the last coordinate is the bias, free of L1. Changes z and n in place."""
    bias = len(z) - 1
    for at, label, weight, *times in rows:
        at = np.append(at, bias)
        w = weights_of(z[at], n[at], at == bias)
        margin = float(w @ np.append(times[0], 1) if times else w.sum())
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, margin))))
        g = weight * (p - label)
        root = np.sqrt(n[at])
        n[at] += g * g
        z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w


def weights_of(z: np.ndarray, n: np.ndarray, free: np.ndarray | bool = False) -> np.ndarray:
    l1 = np.where(free, 0.0, L1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0.0, L2)))


def train(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", sample_per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on texts whose id ``labels`` has. The sample is drawn by a hash of the id, of each class at most about
    ``sample_per_class`` texts and ``sample_bytes`` of text, and rows are weighted back to the classes' shares. Each epoch,
    SHARDS tasks go on from the same state over their rows; what they change in a coordinate is averaged over
    those of them that met it, so that rare coordinates move as far as frequent ones.

    Grams that one text alone holds have the same coordinate after every step, as each sees the gradients of that text
    and no others; so one coordinate a text stands for all of them, and no gram is left out."""
    spark = docs.sparkSession
    toxic = (F.col(label_column) == 1).cast("int")
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(toxic).alias("label"))
    lengths = docs.select(id_column, F.octet_length(text_column).alias("size")).join(known, id_column)
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows at most
    if not sizes:
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    held = {r[0]: r[1] or 0 for r in lengths.groupBy("label").agg(F.sum("size")).collect()}
    share = {k: min(1.0, sample_per_class / n, sample_bytes / max(held.get(k, 0), 1)) for k, n in sizes.items()}
    picked = known.filter(hash_fraction(id_column) < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    sample = docs.select(id_column, text_column).join(F.broadcast(picked), id_column)  # at most 2 * sample_per_class ids

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            hashes, owner = grams(texts_of(batch, text_column))
            pairs = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashes)
            cuts = np.searchsorted(pairs, np.arange(1, batch.num_rows, dtype=np.uint64) << np.uint64(32))
            return {id_column: batch.column(id_column), "label": batch.column("label"), "grams": [x.astype(np.uint32).tobytes() for x in np.split(pairs, cuts)]}

        return each

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = map_texts(sample, make, f"{id_column} {id_type}, label int, grams binary", text_column, SLICE)
    rows = checkpointed(rows.groupBy(id_column, "label").agg(F.min("grams").alias("grams")).coalesce(SHARDS))

    def frequent(batches):
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.uint32)
            for part in range(16):  # by their leading bits, so that little is held at once
                h, c = np.unique(every[every >> 28 == part], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], names=["hash", "n"])

    kept = rows.mapInArrow(frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")
    hashes = np.sort(kept.select("hash").toArrow()["hash"].to_numpy().astype(np.uint32))  # bounded by the sample
    sent_hashes = spark.sparkContext.broadcast(hashes)
    counts = {r["shard"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("shard")).count().collect()}  # SHARDS rows
    first = dict(zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]]).tolist(), strict=False))
    prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    # Shared grams, then a coordinate for each text's own ones, then the bias, which begins at the classes' share.
    z, n = np.zeros(len(hashes) + sum(counts.values()) + 1), np.zeros(len(hashes) + sum(counts.values()) + 1)
    n[-1] = 1.0
    z[-1] = -math.log(prior / (1 - prior)) * (BETA + 1.0) / ALPHA
    weight = {k: 1 / s for k, s in share.items()}

    def numbered(batches):
        """(slice, coordinates of each row's shared grams, the others, the row's own coordinate)."""
        table, row = sent_hashes.value, len(sent_hashes.value) + first.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            for part in slices(batch, "grams", SHUFFLED):
                found = []
                for raw in part.column("grams").to_pylist():
                    h = np.frombuffer(raw, np.uint32)
                    at = np.searchsorted(table, h)
                    ok = at < len(table)
                    ok[ok] = table[at[ok]] == h[ok]
                    found.append((at[ok], h[~ok], row))
                    row += 1
                yield part, found

    for epoch in range(epochs):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches, epoch=epoch, state=state):
            z0, n0 = state.value
            z, n = z0.copy(), n0.copy()
            for part, found in numbered(batches):
                seen = []
                for i, label, (at, own, row) in zip(part.column(id_column).to_pylist(), part.column("label").to_pylist(), found, strict=True):
                    times = np.append(np.ones(len(at)), [len(own)] if len(own) else [])
                    seen.append((crc32(f"{epoch} {i}".encode()), (np.append(at, [row] if len(own) else []).astype(np.int64), float(label == 1), weight.get(label, 1.0), times)))
                ftrl_pass([r for _, r in sorted(seen, key=lambda x: x[0])], z, n)
            moved = np.flatnonzero(n != n0)
            row = [moved.astype(np.int32), (z - z0)[moved], (n - n0)[moved]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["at", "dz", "dn"])

        # A row a shard: the coordinates that it met, bounded by the sample.
        met, dz, dn = np.zeros(len(z), np.int64), np.zeros(len(z)), np.zeros(len(z))
        for shard in rows.mapInArrow(run, "at binary, dz binary, dn binary").toArrow().to_pylist():
            at = np.frombuffer(shard["at"], np.int32)
            met[at] += 1
            dz[at] += np.frombuffer(shard["dz"])
            dn[at] += np.frombuffer(shard["dn"])
        state.destroy()  # every worker has a copy on disk
        z += dz / np.maximum(met, 1)
        n += dn / np.maximum(met, 1)
    w = weights_of(z, n, np.arange(len(z)) == len(z) - 1)
    some = np.flatnonzero(w[: len(hashes)])
    shared, own = (hashes[some], w[some]), w[len(hashes) : -1]
    alone = (np.zeros(0, np.uint32), np.zeros(0))
    if own.any():  # the texts' own grams that L1 has left a weight
        sent = spark.sparkContext.broadcast(own)

        def expand(batches):
            for _, found in numbered(batches):
                mine = [(h, sent.value[row - len(sent_hashes.value)]) for _, h, row in found]
                mine = [(h, x) for h, x in mine if x]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[h.astype(np.int64) for h, _ in mine]])), pa.array(np.concatenate([np.zeros(0), *[np.full(len(h), x) for h, x in mine]]))], names=["hash", "weight"])

        found = rows.mapInArrow(expand, "hash long, weight double").toArrow()
        alone = (found["hash"].to_numpy().astype(np.uint32), found["weight"].to_numpy())
    every, weights = np.concatenate([shared[0], alone[0]]), np.concatenate([shared[1], alone[1]])
    order = np.argsort(every)
    return ToxicityModel(every[order], weights[order], float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: id and score from 0 to 1; every gram of a text counts once. A map over rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(id_column, text_column)

    def make():
        model = sent.value
        low = np.zeros(1 << 20, bool)  # quickly tells most hashes without a weight
        low[model.hashes & 0xFFFFF] = True

        def each(batch: pa.RecordBatch) -> dict:
            hashes, owner = grams(texts_of(batch, text_column))
            maybe = low[hashes & 0xFFFFF]
            pairs = np.unique(owner[maybe].astype(np.uint64) << np.uint64(32) | hashes[maybe])
            h, who = pairs.astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int64)
            total = np.full(batch.num_rows, model.bias)
            if len(model.hashes):
                at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
                total += np.bincount(who, np.where(model.hashes[at] == h, model.weights[at], 0.0), batch.num_rows)
            return {id_column: batch.column(id_column), "score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))}

        return each

    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, score double", text_column, SLICE)
