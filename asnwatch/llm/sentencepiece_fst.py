"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (a space becomes the word mark, a mark is
put before the text), the pieces (a trie whose ends write a piece with its weight) and byte fallback (a
character that no piece covers writes its bytes). They are composed with an input, and the tropical
shortest path through the result is the encoding. For unigram models the weights are the negated
scores. For BPE models a fourth machine forbids (weight infinity) two pieces side by side that merging
would not leave so; exactly one path then has a finite weight, and it is what merging gives.

Contract for odd input: a null or empty text has no ids and decodes to an empty text; repeated rows are
encoded alike; text that only the fallback covers comes back byte for byte; long texts are encoded whole;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from asnwatch.llm.common import held, map_texts, texts_of

MARK = "▁"
#: Segments and pairs of pieces that a worker remembers.
REMEMBERED = 400_000
_BPE = 2


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, type(model.pieces[0])
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that normalise by word marks alone are supported")
        if not model.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == _BPE
        self.pieces = [p.piece for p in model.pieces]
        self.number: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.written = [b""] * len(self.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                self.written[i] = bytes([value])
            elif p.type == kind.UNKNOWN:
                self.written[i] = " ⁇ ".encode()
            elif p.type != kind.CONTROL:
                self.number[p.piece], self.score[p.piece] = i, p.score
                self.written[i] = p.piece.replace(MARK, " ").encode()
        self.trie: dict = {}
        inside: set[str] = set()
        for piece in self.number:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
            inside.update(map("".join, zip(piece, piece[1:], strict=False)))
        #: Pairs of characters that some piece holds side by side; between all others every path has a cut.
        self.inside = inside
        marks = all(x[1] != MARK or x[0] == MARK for x in inside)
        self.segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if marks else "(?s).+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as BPE defines it: the adjacent pair of the best-scored piece first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, left: str, right: str) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = left + right not in self.score and self.merged(left + right) == [left, right]
        return known

    def shortest_path(self, text: str) -> list[str]:
        """Pieces (or single uncovered characters) along the path of least weight through normalised text."""
        n, score, pairs, merges = len(text), self.score, self.pairs, self.merges
        weight = [math.inf] * (n + 1)
        weight[0] = 0.0
        last: list[str | None] = [None] * (n + 1)
        for i in range(n):
            so_far = weight[i]
            if so_far == math.inf:
                continue
            before, node, covered = last[i], self.trie, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    covered |= j == i
                    w = so_far - score[piece]
                    if w < weight[j + 1]:
                        ok = True
                        if merges and before is not None:
                            ok = pairs.get((before, piece))
                            if ok is None:
                                ok = self.allowed(before, piece)
                        if ok:
                            weight[j + 1], last[j + 1] = w, piece
            if not covered:  # byte fallback, which no merge crosses
                weight[i + 1], last[i + 1] = so_far, text[i]
        out, j = [], n
        while j:
            piece = last[j]
            out.append(piece)
            j -= len(piece)
        return out[::-1]

    def _path_ids(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.shortest_path(text):
            number = self.number.get(piece)
            if number is None:
                ids += [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(number)
        return np.array(ids, "<u4").tobytes()

    def _ids(self, segment: str) -> bytes:
        """Ids of one segment, cut where no piece reaches across."""
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.inside]
        if not cuts:
            return self._path_ids(segment)
        out = []
        for start, stop in zip([0, *cuts], [*cuts, len(segment)], strict=True):
            part = segment[start:stop]
            ids = self.known.get(part)
            if ids is None:
                ids = self._path_ids(part)
                if len(part) <= 64:
                    self.known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for segment in self.segment.findall(self.prefix + text.replace(" ", MARK)):
            ids = known.get(segment)
            if ids is None:
                ids = self._ids(segment)
                if len(segment) <= 64:
                    known[segment] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.written.__getitem__, ids.tolist()))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def shared_transducer(path: str) -> PieceTransducer:
    """One for each Python worker, so that its tasks share what it remembers."""
    return held(f"transducer {path}", lambda: PieceTransducer(path))


def encode(docs: DataFrame, model: str | None = None, digest: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: id and ids, or with ``digest`` n_ids, n_byte_ids, ids_crc32 (of little-endian
    unsigned 32-bit ids) and round_trip (whether the ids decode to the text). A map over rows, no shuffle."""
    path = model or model_path()
    kept = docs.select(id_column, text_column)
    id_type = kept.schema[id_column].dataType.simpleString()

    def make():
        machine = shared_transducer(path)
        is_byte = np.zeros(len(machine.pieces), bool)
        is_byte[machine.byte] = True

        def each(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch, text_column)
            ids = [machine.encode(t) for t in texts]
            if not digest:
                return {id_column: batch.column(id_column), "ids": [x.astype(np.int32) for x in ids]}
            return {
                id_column: batch.column(id_column),
                "n_ids": [len(x) for x in ids],
                "n_byte_ids": [int(is_byte[x].sum()) for x in ids],
                "ids_crc32": [crc32(x.tobytes()) for x in ids],
                "round_trip": [machine.decode(x) == t for x, t in zip(ids, texts, strict=True)],
            }

        return each

    columns = "n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return map_texts(kept, make, f"{id_column} {id_type}, {columns}", text_column, holds=f"transducer {path}")


def decode(encoded: DataFrame, model: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """For each row of ``encoded``: id and text."""
    path = model or model_path()
    kept = encoded.select(id_column, ids_column)

    def run(batches):
        machine = shared_transducer(path)
        for batch in batches:
            texts = [machine.decode(np.array(x or [], np.int64)) for x in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(texts, pa.string())], names=[id_column, "text"])

    return kept.mapInArrow(run, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, text string")
