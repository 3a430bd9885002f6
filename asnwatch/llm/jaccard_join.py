"""Near duplicates: a Jaccard join over word shingles with a MinHash LSH forest.

Texts with equal shingle sets are one node. Every node has a path of DEPTH MinHash labels in each of TREES
prefix tries; a trie node is a beginning of a path, so nodes under it are those with equal beginnings. The join
starts at the longest prefixes. There, first in one tree and then in all, one node of each component under a
trie node is verified against one of its largest component, and verified pairs merge components: a crowd of
near copies costs a few comparisons a node. Then, level by level, all pairs of different components that meet
under a prefix of that length are verified and the prefixes are shortened, until the recall that the weakest
links found so far let expect reaches the target, or links at the threshold itself do. Before the exact
comparison of shingle sets, sizes and one-bit labels rule pairs out. Where many nodes meet, pairs would grow with
the square of their number: at the last level these trie nodes are cut into blocks, sets are sent block by block
and links alone come out. Links are counted after that: both ends of a link are in one class, so each class is
cut into blocks and every two blocks are compared exactly.

Contract for odd input: a text of fewer than WORDS words is one shingle; a text without words, null or empty,
resembles nothing and is a class of its own; copies, also repeated rows, share a class; rows that repeat an id
with another text count by their texts; a null id has a null class and links nothing; the smallest id names a
class; long texts are taken whole; ids keep their type; an empty table has no classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed, few_tasks, map_texts, small_batches, texts_of
from asnwatch.llm.licenses import word_table

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.995
#: Links of a similarity less than this above the threshold are the weakest ones, which the measured recall is of.
WEAKEST = 0.1
SEED = 6
#: One-bit labels may differ in so many standard deviations more than those of a pair at the threshold do.
SPREAD = 5.6
#: Candidate ids are broadcast up to this number (40 bytes each), beyond it joined by shuffle.
BROADCAST_IDS = 400_000
#: Pairs whose sets a task compares.
TASK_PAIRS = 5_000
#: Where more nodes than this meet under a prefix, they are compared in blocks; fewer make pairs.
CROWD = 32
#: Nodes and bytes of shingles of a block, about, and shingles compared at once.
BLOCK_NODES = 1024
BLOCK_BYTES = 4 << 20
BLOCK_WIDTH = 1024

_LABELS = TREES * DEPTH
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(1, 1 << 32, _LABELS, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, _LABELS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What a pair is judged by before its sets are fetched.
_SKETCH = ("size", "bits1", "bits2")


def shingles(text: str, table: bytes = word_table(), n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``n`` words (lower case, split at ASCII punctuation and space)."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(table).split()
    if not words:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ code[i : len(code) - size + 1 + i]) * _MIX
        h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """_LABELS MinHash labels of 16 bits."""
    low = np.full(_LABELS, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(16)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _FACTORS + _TERMS).min(axis=0), out=low)
    return ((low.astype(np.uint64) * _MIX) >> np.uint64(48)).astype("<u2")


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair of that similarity meets under a prefix of ``depth`` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall, else 1."""
    return next((k for k in range(depth, 0, -1) if recall(threshold, k, trees) >= target), 1)


def most_bits(threshold: float) -> int:
    """One-bit labels in which a pair at the threshold may differ: SPREAD standard deviations above the mean."""
    p = (1 - threshold) / 2
    return min(_LABELS, math.ceil(_LABELS * p + SPREAD * math.sqrt(_LABELS * p * (1 - p))))


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_hash, text): id and text hash tell rows of different texts apart."""
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"), F.col(text_column).alias("text"))


def _sketches(named: DataFrame) -> DataFrame:
    def make():
        table = word_table()

        def each(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, table) for t in texts_of(batch)]
            some = [signature(s) for s in sets if len(s)]
            bits = np.packbits((np.array(some, np.uint16).reshape(len(some), _LABELS) & 1).astype(bool), axis=1).view(np.int64).reshape(len(some), 2)
            labels, halves = iter(some), iter(bits.tolist())
            out: dict[str, list] = {n: [] for n in ("set_key", "size", "signature", "bits1", "bits2")}
            for s in sets:
                row = (xxhash.xxh3_128_digest(s.tobytes()), len(s), next(labels).tobytes(), *next(halves)) if len(s) else (None,) * 5
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            return {"id": batch.column("id"), "text_hash": batch.column("text_hash")} | out

        return each

    id_type = named.schema["id"].dataType.simpleString()
    return map_texts(named, make, f"id {id_type}, text_hash long, set_key binary, size int, signature binary, bits1 long, bits2 long")


def _trie_nodes(nodes: DataFrame, depth: int, trees: range = range(TREES)) -> DataFrame:
    """Each node once for each of ``trees``: ``key`` stands for the first ``depth`` labels of its path there and
    ``next`` for the label after them."""
    at = lambda tree, i: F.substring("signature", 2 * (tree * DEPTH + i) + 1, 2)
    path = [F.struct(F.xxhash64(F.lit(t), F.substring("signature", 2 * t * DEPTH + 1, 2 * depth)).alias("key"), (at(t, depth) if depth < DEPTH else F.lit(None).cast("binary")).alias("next")) for t in trees]
    return nodes.select(F.inline(F.array(*path)), *[c for c in nodes.columns if c != "signature"])


def _alike(threshold: float, suffix: str = "_") -> Column:
    """Whether sizes and one-bit labels leave a pair a chance to reach the threshold."""
    differ = F.bit_count(F.col("bits1").bitwiseXOR(F.col(f"bits1{suffix}"))) + F.bit_count(F.col("bits2").bitwiseXOR(F.col(f"bits2{suffix}")))
    size, other = F.col("size"), F.col(f"size{suffix}")
    return (F.least(size, other) >= threshold * F.greatest(size, other)) & (differ <= most_bits(threshold))


def _merge(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: where both sides are small, a broadcast of one would cost the driver more than it saves."""
    return left.join(right.hint("merge"), on, how)


def _components_by_key(rows: DataFrame, n_rows: int) -> DataFrame:
    """(key, comp, n, first): the components under each key, their sizes and smallest nodes with their sketches."""
    first = F.min_by(F.struct("node", *_SKETCH), "node").alias("first")
    return few_tasks(rows.groupBy("key", "comp").agg(F.count("*").alias("n"), first), n_rows)


def _star_pairs(rows: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """Pairs (a, b): under each key, the smallest node of the largest component, the first of equals, and that of
    every other one. So links point to few nodes and components stay shallow."""
    each = _components_by_key(rows, n_rows)
    largest = each.groupBy("key").agg(F.max_by(F.struct("comp", "first"), F.struct("n", -F.col("comp"))).alias("top"), F.count("*").alias("n_comps")).filter("n_comps > 1")
    both = _merge(each, largest, "key").filter(F.col("comp") != F.col("top.comp"))
    flat = both.select("first.*", *[F.col(f"top.first.{c}").alias(f"{c}_") for c in ("node", *_SKETCH)]).filter(_alike(threshold))
    return few_tasks(flat.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")), n_rows).distinct()


def _mixed(rows: DataFrame, n_rows: int) -> DataFrame:
    """(key, largest, n, few, bytes, few_bytes) of the keys under which several components meet: the largest of them, and
    how many nodes there are, also outside it, and bytes of shingles."""
    each = few_tasks(rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes")), n_rows)
    top = F.max(F.struct("n", "comp", "bytes")).alias("top")
    keys = each.groupBy("key").agg(top, F.count("*").alias("n_comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("n_comps > 1")
    return keys.select("key", F.col("top.comp").alias("largest"), "n", (F.col("n") - F.col("top.n")).alias("few"), "bytes", (F.col("bytes") - F.col("top.bytes")).alias("few_bytes"))


def _rest_pairs(rows: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components under keys of at most CROWD nodes that their sketches do not rule
    out. Pairs with equal next labels meet under a longer prefix already."""
    keys = _mixed(rows, n_rows).filter(F.col("n") <= CROWD).select("key")
    inside = few_tasks(_merge(few_tasks(rows, n_rows), keys, "key"), n_rows)
    other = inside.select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "comp", "next", *_SKETCH)])
    fresh = F.col("next").isNull() | (F.col("next") != F.col("next_"))
    pairs = _merge(inside, other, "key").filter((F.col("comp") != F.col("comp_")) & (F.col("node") < F.col("node_")) & fresh & _alike(threshold))
    return few_tasks(pairs.select(F.col("node").alias("a"), F.col("node_").alias("b")), n_rows).distinct()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets numbered ``left`` shares with each of ``right``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[code] > 1
    code, owner = (np.cumsum(held > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, BLOCK_WIDTH):
        a, b = np.searchsorted(code, (start, start + BLOCK_WIDTH))
        has = np.zeros((len(sets), BLOCK_WIDTH), np.float32)
        has[owner[a:b], code[a:b] - start] = 1
        both += has[left] @ has[right].T
    return both.astype(np.float64)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Of rows sorted by ``keys``: each group's key, its ``columns`` as arrays, and its shingle sets."""
    group, held, sets = None, [], []
    for batch in batches:
        ends, flat = batch.column("shingles").offsets.to_numpy(), batch.column("shingles").values.to_numpy()
        at = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        rest = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        for k, (key, row) in enumerate(zip(at, rest, strict=True)):
            if key != group:
                if sets:
                    yield group, *map(np.array, zip(*held, strict=True)), sets
                group, held, sets = key, [], []
            held.append(row)
            sets.append(flat[ends[k] : ends[k + 1]].copy())
    if sets:
        yield group, *map(np.array, zip(*held, strict=True)), sets


def _blocks(n: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_NODES, F.col(size) / BLOCK_BYTES)).cast("int")


def crowded_links(rows: DataFrame, n_rows: int, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): under keys of more than CROWD nodes, the best link of every node outside the largest
    component to each other component that it has links to. Both sides are cut into blocks by a hash of the node,
    each two blocks are a group of their own, and pairs are never rows."""
    keys = _mixed(rows, n_rows).filter(F.col("n") > CROWD).select("key", "largest", _blocks("n", "bytes").alias("wide"), _blocks("few", "few_bytes").alias("high"))
    inside = _merge(rows, keys, "key").select("key", "node", "comp", "largest", "wide", "high")
    block = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = inside.select("key", "node", "comp", F.lit(False).alias("asks"), block("wide").alias("i"), every("high").alias("j"))
    right = inside.filter("comp <> largest").select("key", "node", "comp", F.lit(True).alias("asks"), every("wide").alias("i"), block("high").alias("j"))

    def run(batches):
        for _, node, comp, asks, held in _groups(batches, ("key", "i", "j"), ("node", "comp", "asks")):
            a, b = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(a) or not len(b):
                continue
            size = np.array([len(s) for s in held], float)
            both = _overlaps(held, a, b)
            similarity = both / (size[a][:, None] + size[b] - both)
            linked = (both >= threshold * (size[a][:, None] + size[b] - both)) & (comp[a][:, None] != comp[b])
            x, y = np.nonzero(linked)
            order = np.lexsort((-similarity[x, y], comp[a][x], y))
            x, y = x[order], y[order]
            first = np.ones(len(x), bool)
            first[1:] = (y[1:] != y[:-1]) | (comp[a][x[1:]] != comp[a][x[:-1]])
            x, y = x[first], y[first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[a][x], node[b][y], similarity[x, y])], names=["a", "b", "similarity"])

    dealt = _merge(left.union(right), sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    with small_batches(rows.sparkSession):
        return checkpointed(few_tasks(dealt.mapInArrow(run, "a long, b long, similarity double").distinct(), n_rows))


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the pairs whose exact Jaccard similarity reaches the threshold."""
    if n_pairs <= BROADCAST_IDS // 2:  # only their sets are sent
        asked = few_tasks(few_tasks(pairs, n_pairs).select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n_pairs)
        sets = sets.join(F.broadcast(asked), "node", "left_semi")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    left = few_tasks(_merge(few_tasks(pairs, n_pairs), side("b"), "b"), n_pairs, TASK_PAIRS)
    both = few_tasks(_merge(left, side("a"), "a"), n_pairs, TASK_PAIRS)
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b"))).withColumn("all", F.size("set_a") + F.size("set_b") - F.col("common"))
    return both.filter(F.col("common") >= threshold * F.col("all")).select("a", "b", (F.col("common") / F.col("all")).alias("similarity"))


def measured_recall(links: DataFrame, threshold: float, depth: int) -> float:
    """The share of all weakest links that those found at ``depth`` seem to be, if each stands for as many as one over
    the chance that it had to be found (1 if there are none)."""
    weak = links.filter(F.col("similarity") < threshold + WEAKEST)
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(TREES))
    sums = weak.agg(F.count("*").alias("found"), F.sum(1 / chance).alias("expected")).first()
    return sums["found"] / sums["expected"] if sums["found"] else 1.0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it is connected to.
    Alternating large-star and small-star steps until nothing moves; hubs never gather in one task."""
    n = links.count()

    def pulled(edges: DataFrame) -> DataFrame:
        """Edges (u, v) become (v, least neighbour of u)."""
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return few_tasks(_merge(edges, least, "u"), n)

    edges = few_tasks(links, n).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = checkpointed(few_tasks(edges, n)), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return checkpointed(few_tasks(roots.union(edges.select("v", "v").distinct()), n))
        before, n = state, state[0]
        both = edges.union(edges.select("v", "u"))
        large = pulled(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = pulled(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(few_tasks(few_tasks(small, n).distinct(), n))


def _links_of(sets: list[np.ndarray], block: np.ndarray, threshold: float) -> np.ndarray:
    """For each set, how many sets of the other block, or of its own if there is one only, reach the threshold."""
    sizes = np.array([len(s) for s in sets], float)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    both = _overlaps(sets, left, right)
    linked = both >= threshold * (sizes[left][:, None] + sizes[right] - both)
    out = np.zeros(len(sets), np.int64)
    if block.min() == block.max():
        np.fill_diagonal(linked, False)
        out[left] = linked.sum(axis=1)
    else:
        out[left], out[right] = linked.sum(axis=1), linked.sum(axis=0)
    return out


def link_counts(roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): for each node of ``roots`` (node, root), the nodes of its component whose exact similarity
    reaches the threshold. Components are cut into blocks by a hash of the node, and each two blocks of one are a
    group of their own, so a large component is spread and its pairs are never rows."""
    members = checkpointed(_merge(roots, sets, "node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("shingles") * 8).alias("bytes")).select("root", _blocks("n", "bytes").alias("blocks"))
    own = _merge(members, sizes, "root").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = each.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "shingles")

    def run(batches):
        for (_, i, j), node, block, held in _groups(batches, ("root", "i", "j"), ("node", "block")):
            # Two blocks of which one is empty have no pair; its own group counts the other.
            if i == j or block.min() != block.max():
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_links_of(held, block, threshold))], names=["node", "n"])

    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    with small_batches(roots.sparkSession):
        return checkpointed(dealt.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links")))


def _sets(named: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, rep), from the row that each is known by."""

    def make():
        table = word_table()

        def each(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, table) for t in texts_of(batch)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            return {"node": batch.column("node"), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

        return each

    side = wanted.select("node", F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash"))
    texts = named.join(F.broadcast(side) if n_wanted <= BROADCAST_IDS else side, ["id", "text_hash"]).select("node", "text")
    return checkpointed(few_tasks(map_texts(texts, make, "node long, shingles array<long>").dropDuplicates(["node"]), n_wanted, TASK_PAIRS))


def classified(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: id, text_hash, class_id, n_links, and whether the row is the ``first`` of its class, the
    one with the smallest id and of those with the smallest text hash (repeated rows are all first)."""
    named = _named(docs, id_column, text_column)
    sketches = checkpointed(_sketches(named))
    rows = sketches.select("id", "text_hash", "set_key")
    grouped = sketches.filter(F.col("set_key").isNotNull() & F.col("id").isNotNull()).groupBy("set_key")
    nodes = grouped.agg(F.min(F.struct("id", "text_hash")).alias("rep"), *[F.first(c).alias(c) for c in ("signature", *_SKETCH)])
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbered once, then read
    floor = shallowest(threshold)

    # Only nodes that share the shortest prefix with another can have links; their shingles are kept.
    alone = _trie_nodes(nodes.select("node", "signature"), floor).select("key", "node")
    shared = alone.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    wanted = checkpointed(alone.join(shared, "key").select(F.col("node").alias("wanted")).distinct())
    n_wanted = wanted.count()
    side = F.broadcast(few_tasks(wanted, n_wanted)) if n_wanted <= BROADCAST_IDS else wanted
    inner = checkpointed(few_tasks(nodes.join(side, F.col("node") == F.col("wanted"), "left_semi").drop("set_key"), n_wanted))
    sets = _sets(named, inner.select("node", "rep"), n_wanted)

    found: DataFrame | None = None  # all links so far, and all pairs looked at
    asked: DataFrame | None = None
    roots: DataFrame | None = None

    def forest(depth: int, trees: range) -> tuple[DataFrame, int]:
        sketch = inner.select("node", "signature", *_SKETCH)
        placed = sketch.withColumn("comp", F.col("node")) if roots is None else few_tasks(_merge(sketch, roots, "node", "left"), n_wanted).withColumn("comp", F.coalesce("root", "node")).drop("root")
        return few_tasks(_trie_nodes(placed, depth, trees), n_wanted * len(trees)), n_wanted * len(trees)

    def merge(links: DataFrame) -> None:
        nonlocal roots
        chains = links.select("a", "b")
        roots = components(chains if roots is None else chains.union(roots.filter("node <> root").select("root", "node")))

    def verified(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs not asked for before, none if there are no such pairs; they count as found."""
        nonlocal asked, found
        if asked is not None:
            pairs = _merge(few_tasks(pairs, n_wanted), few_tasks(asked, n_wanted), ["a", "b"], "left_anti")
        pairs = checkpointed(few_tasks(pairs, n_wanted))
        asked = pairs if asked is None else asked.union(pairs)
        if not (n_pairs := pairs.count()):
            return None
        links = checkpointed(_verified(pairs, n_pairs, sets, threshold))
        found = links if found is None else found.union(links)
        return links

    if n_wanted:
        for trees in (range(1), range(TREES)):
            if (links := verified(_star_pairs(*forest(DEPTH, trees), threshold))) is not None:
                merge(links)
        merged = found
        for depth in range(DEPTH, floor - 1, -1):
            verified(_rest_pairs(*forest(depth, range(TREES)), threshold))
            if depth == floor or found is None or measured_recall(found, threshold, depth) >= TARGET_RECALL:
                break
        if found is not merged:
            merge(found)
        crowded = crowded_links(*forest(depth, range(TREES)), sets, threshold)
        if not crowded.isEmpty():
            merge(crowded)

    each = nodes.select("set_key", "node", "rep")
    if roots is None:
        named_classes = each.select("set_key", "rep", F.col("rep.id").alias("class_id"), F.col("rep").alias("keeper"), F.lit(0).cast("long").alias("n_links"))
    else:
        degrees = link_counts(roots, sets, threshold)
        keepers = roots.join(inner.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("keeper"))
        linked = roots.join(keepers, "root").join(degrees, "node", "left").select("node", "keeper", "n_links")
        joined = each.join(linked, "node", "left").withColumn("keeper", F.coalesce("keeper", "rep"))
        named_classes = joined.select("set_key", "keeper", F.col("keeper.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    known = F.col("id").isNotNull()
    out = rows.filter("set_key is not null").join(named_classes.select("set_key", "keeper", "class_id", "n_links"), "set_key", "left")
    out = out.select("id", "text_hash", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("n_links")).otherwise(0).alias("n_links"), (F.struct("id", "text_hash") == F.col("keeper")).alias("first"))
    # Texts without words are not joined: they all lack a key.
    wordless = rows.filter("set_key is null").select("id", "text_hash", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return out.union(wordless).withColumn("first", ~known | F.coalesce("first", F.lit(True)))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, class_id (the smallest id of its class: documents connected by
    similarities of ``threshold`` and more), and n_links, to how many different texts of its class its own
    is as similar as that."""
    return classified(docs, threshold, id_column, text_column).select(F.col("id").alias(id_column), "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class its first row, of repeated rows one. Rows with a
    null id all stay, and rows without words but for repeated ones."""
    judged = checkpointed(classified(docs, threshold, id_column, text_column).select("id", "text_hash", "first").filter("id is not null"))
    # A text without words has an id and hash of its own like any other.
    key = ["_id", "_text_hash"]
    dropped = judged.filter("not first").select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).distinct()
    again = judged.filter("first").groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {n: F.col(f"c{names.index(n)}") for n in (id_column, text_column)}
    keyed = plain.withColumns({"_id": of[id_column], "_text_hash": F.xxhash64(F.coalesce(of[text_column], F.lit("")))})

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    kept = keyed.join(side(dropped), key, "left_anti")
    if not again.isEmpty():
        again = side(checkpointed(again))
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.drop(*key).toDF(*names)
