"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, computed by a forward algorithm; expectation
maximisation (forward-backward) fits the pieces on a bounded sample of labelled texts.

Contract for odd input: a null text, or one without a letter, is ``und`` with score 0; null
languages are not learned from; repeated rows are scored alike; without training rows every text
is ``und``. Words of any length are summed over whole, also when they teach; equally likely languages go to the first by name; ids and carried columns keep their types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, ddl, hash_fraction, map_texts, texts_of

UNDETERMINED = "und"
#: Texts of each language that the fit reads, about, at most.
SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 3
#: Dirichlet count of every piece, so that none has probability 0.
SMOOTHING = 0.05
#: Words and bytes of words scored together, words that a task remembers, and bytes of text whose words are held at a time.
BATCH = 20_000
BATCH_BYTES = 160_000
REMEMBERED = 200_000
#: Sums over segmentations are scaled anew after so many bytes.
RESCALED = 8
SLICE = 2 << 20

_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str | None = None) -> list[bytes]:
    """Lower-case pieces of a public vocabulary as bytes, a leading space for a word start, and all single bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and piece == piece.lower():
            raw = piece.replace("▁", " ").encode()
            if _WORD.fullmatch(piece.replace("▁", "")):  # others match no word
                pieces.add(raw)
    return sorted(pieces)


class Lattice:
    """All matches of pieces in a batch of words, and sums over the paths through them."""

    def __init__(self, pieces: list[bytes]):
        nodes: list[dict[int, int]] = [{}, {}]  # 0 is dead, 1 the root
        ends = [-1, -1]
        for i, piece in enumerate(pieces):
            at = 1
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][byte]
            ends[at] = i
        used = sorted({b for n in nodes[2:] for b in n})
        self.depth = max(map(len, pieces), default=1)
        # Below the root only the bytes that continue a piece have a column; 0 leads to the dead node.
        self.column = np.zeros(257, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.next = np.zeros((len(nodes), len(used) + 1), np.int32)
        for i, n in enumerate(nodes[2:], 2):
            for b, j in n.items():
                self.next[i, self.column[b]] = j
        self.first = np.zeros(257, np.int32)
        for b, j in nodes[1].items():
            self.first[b] = j
        self.piece = np.array(ends, np.int32)

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Word lengths; matches in groups of equal (offset, length): those two, word numbers, piece numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + bytes(1), np.uint8).astype(np.int32)
        owner = np.repeat(np.arange(len(words)), sizes)
        begin = np.cumsum(sizes) - sizes
        stop = (begin + sizes)[owner]
        place = np.arange(len(owner))
        offset = place - begin[owner]
        keys, owners, found = [], [], []
        state = self.first[text[:-1]]
        for length in range(1, self.depth + 1):
            ok = self.piece[state] >= 0
            keys.append(offset[ok] * (self.depth + 1) + length)
            owners.append(owner[ok])
            found.append(self.piece[state[ok]])
            inside = place + length < stop
            place, offset, owner, stop, state = (x[inside] for x in (place, offset, owner, stop, state))
            state = self.next[state, self.column[text[place + length]]]
            alive = state > 0
            place, offset, owner, stop, state = (x[alive] for x in (place, offset, owner, stop, state))
            if not len(place):
                break
        key, who, which = np.concatenate(keys), np.concatenate(owners), np.concatenate(found)
        order = np.argsort(key, kind="stable")
        key, who, which = key[order], who[order], which[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        groups = [(*divmod(int(k[0]), self.depth + 1), w, p) for k, w, p in zip(np.split(key, cuts), np.split(who, cuts), np.split(which, cuts), strict=True) if len(k)]
        return sizes, groups

    def log_probability(self, words: list[bytes], prob: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in each language, the words not empty."""
        out = np.empty((len(words), prob.shape[1]))
        for part in _lots(words, BATCH_BYTES):
            out[part] = self._forward([words[i] for i in part], prob)
        return out

    def _forward(self, words: list[bytes], prob: np.ndarray) -> np.ndarray:
        """Words in order of length. ``ring`` holds the sums up to the next places that a piece may reach, in each
        language relative to ``scale``."""
        sizes, groups = self.matches(words)
        ring = np.zeros((self.depth + 1, len(words), prob.shape[1]))
        ring[0] = 1
        scale = np.zeros(ring.shape[1:])
        out, at, done = np.empty(scale.shape), -1, 0
        for offset, length, who, which in groups:
            if offset > at:  # all that leads here is summed
                if at >= 0:
                    ring[at % len(ring)] = 0
                at, row = offset, ring[offset % len(ring)]
                over = int(np.searchsorted(sizes, offset, side="right"))
                out[done:over] = np.log(row[done:over]) + scale[done:over]
                done = over
                if offset and offset % RESCALED == 0:
                    by = row[done:].copy()
                    ring[:, done:] /= by
                    scale[done:] += np.log(by)
            ring[(offset + length) % len(ring), who] += row[who] * prob[which]
        last = ring[(at + 1) % len(ring), done:]
        out[done:] = np.log(last) + scale[done:]
        return out

    def expected_counts(self, words: list[bytes], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; weight holds the words' counts by language. Sums from either
        end are kept relative to ``log_scale``, which goes on every RESCALED bytes, so words of any length stay in range."""
        out = np.zeros(prob.shape)
        for part in _lots(words, BATCH_BYTES, padded=True):
            some = [words[i] for i in part]
            sizes, groups = self.matches(some)
            every, longest = np.arange(len(some)), int(sizes[-1])
            alpha = np.zeros((longest + 1, len(some), prob.shape[1]))
            alpha[0] = 1
            log_scale = np.zeros((longest // RESCALED + 1, *alpha.shape[1:]))
            at = 0
            for offset, length, who, which in groups:
                if offset > at and offset % RESCALED == 0:  # all that leads here is summed
                    by = np.where((sizes[:, None] > offset) & (alpha[offset] > 0), alpha[offset], 1.0)
                    alpha[offset : offset + self.depth] /= by
                    log_scale[offset // RESCALED] = log_scale[offset // RESCALED - 1] + np.log(by)
                at = offset
                alpha[offset + length, who] += alpha[offset, who] * prob[which]
            scale = weight[part] / alpha[sizes, every]
            beta = np.zeros_like(alpha)
            beta[sizes, every] = 1
            for offset, length, who, which in reversed(groups):
                onward = prob[which] * beta[offset + length, who]
                here, there = offset // RESCALED, np.minimum((offset + length) // RESCALED, (sizes[who] - 1) // RESCALED)
                if (offset + length) // RESCALED > here:
                    onward *= np.exp(log_scale[here, who] - log_scale[there, who])
                beta[offset, who] += onward
                share = alpha[offset, who] * onward * scale[who]
                for lang in range(prob.shape[1]):
                    out[:, lang] += np.bincount(which, share[:, lang], len(out))
        return out


def _lots(words: list[bytes], most: int, padded: bool = False) -> Iterator[np.ndarray]:
    """Numbers of the words in order of length, in lots of at most BATCH and, unless it is one word, ``most`` bytes
    (each word as long as the lot's longest if ``padded``)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    start, held = 0, 0
    for i, size in enumerate(sizes[order].tolist()):
        held = (i - start + 1) * size if padded else held + size
        if i > start and (i - start >= BATCH or held > most):
            yield order[start:i]
            start, held = i, size
    if len(words):
        yield order[start:]


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities by language; its size is bounded by the vocabulary."""

    languages: tuple[str, ...]
    pieces: tuple[bytes, ...]
    probability: np.ndarray


def words_of(text: str) -> list[bytes]:
    """The words of a text, each with its start mark."""
    return [b" " + w.encode() for w in _WORD.findall(text.lower())]


def _normalised(counts: np.ndarray) -> np.ndarray:
    return (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)


def train(docs: DataFrame, pieces: list[bytes] | None = None, lang_column: str = "lang", id_column: str = "doc_id", text_column: str = "text", sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on rows of ``docs`` with a language. The sample is drawn by a hash of the id, of each language
    about ``sample_per_language`` texts at most; word counts and every round run as Spark jobs, the driver
    sees piece counts only (vocabulary times languages)."""
    labelled = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_column).count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), (), np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_per_language / sizes[lang]))])
    sample = labelled.filter(hash_fraction(id_column) < share[F.col(lang_column)])
    number = {lang: i for i, lang in enumerate(languages)}

    def make_words():
        def each(batch: pa.RecordBatch) -> dict:
            counts: dict[tuple[int, bytes], int] = {}
            for lang, text in zip(batch.column(lang_column).to_pylist(), texts_of(batch, text_column), strict=True):
                i = number[lang]
                for word in words_of(text):
                    counts[i, word] = counts.get((i, word), 0) + 1
            return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

        return each

    words = map_texts(sample.select(lang_column, text_column), make_words, "lang int, word binary, n long", text_column, SLICE)
    table = checkpointed(words.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(len(languages))]))
    pieces = pieces or vocabulary()

    def round_of(prob: np.ndarray) -> np.ndarray:
        def run(batches):
            lattice, total = Lattice(pieces), np.zeros(prob.shape)
            for batch in batches:
                if batch.num_rows:
                    weight = np.stack([batch.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1)
                    total += lattice.expected_counts(batch.column("word").to_pylist(), weight, prob)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang], pa.float64())], names=["piece", "lang", "n"])

        rows = table.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(prob.shape)
        counts[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        return counts

    prob = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        prob = _normalised(round_of(prob))
    return LanguageModel(languages, tuple(pieces), prob)


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: id, the columns ``carry``, lang_pred, score (posterior of that language under equal priors)
    and log_prob_per_byte of the letters. A map over rows with the model broadcast; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*dict.fromkeys([id_column, text_column, *carry]))
    out = list(dict.fromkeys([id_column, *carry]))

    def make():
        model = sent.value
        lattice = Lattice(list(model.pieces)) if model.languages else None
        number: dict[bytes, int] = {}
        known = np.zeros((0, len(model.languages)))

        def each(batch: pa.RecordBatch) -> dict:
            nonlocal number, known
            texts = [words_of(t) for t in texts_of(batch, text_column)]
            sizes = np.array([len(t) for t in texts])
            best, score, rate = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if lattice and sizes.sum():
                if len(number) > REMEMBERED:
                    number, known = {}, known[:0]
                flat = [w for t in texts for w in t]
                fresh = [w for w in dict.fromkeys(flat) if w not in number]
                if fresh:
                    number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
                    known = np.concatenate([known, lattice.log_probability(fresh, model.probability)])
                at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                total = np.add.reduceat(known[at], starts)
                size = np.add.reduceat(np.fromiter(map(len, flat), np.int64, len(flat)), starts)
                top = total.max(axis=1)
                best[some] = total.argmax(axis=1)
                score[some] = 1 / np.exp(total - top[:, None]).sum(axis=1)
                rate[some] = top / size
            return {c: batch.column(c) for c in out} | {
                "lang_pred": [model.languages[i] if i >= 0 else UNDETERMINED for i in best.tolist()],
                "score": score,
                "log_prob_per_byte": pa.array(rate, from_pandas=True),
            }

        return each

    return map_texts(kept, make, f"{ddl(kept, out)}, lang_pred string, score double, log_prob_per_byte double", text_column, SLICE)
