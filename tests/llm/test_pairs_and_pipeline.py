import math
import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from asnwatch.llm import common, hamming_search, jaccard_join, langid, packing, quality_model, queries


def near(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as class_id")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df, **options).collect())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))] for _ in range(40)]
    rows = []
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 6])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(changed)))
    crowd = [f"c{i}" for i in range(200)]
    for i in range(120):  # near copies of one text
        changed = list(crowd)
        changed[i] = f"y{i}"
        rows.append((len(rows), " ".join(changed)))
    sets = {i: jaccard_join.shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b:
                both = len(np.intersect1d(x, y))
                if both >= 0.8 * (len(x) + len(y) - both):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    got = near(spark, rows)
    assert [(i, c) for i, c, _ in got] == [(i, find(i)) for i, _ in rows]
    assert all(links < 120 * 16 for *_, links in got)


def test_near_duplicates_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 16)  # several blocks a crowd
    rng = random.Random(5)
    crowd, texts = [f"c{i}" for i in range(200)], []
    for i in range(60):  # near copies of one text
        texts.append([*crowd[:i], f"y{i}", *crowd[i + 1 :]])
    for i in range(40):  # a chain: neighbours are linked, ends are not
        texts.append([f"d{j}" for j in range(3 * i, 3 * i + 60)])
    texts += [[f"w{rng.randrange(500)}" for _ in range(50)] for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, texts[0], texts[70]])]  # copies are no links
    sets = [set(jaccard_join.shingles(" ".join(t)).tolist()) for t in texts]
    links = [sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1 for x in sets]
    assert min(links[:60]) == 59
    assert [n for *_, n in near(spark, rows)] == [*links, links[0], links[70]]


def test_crowds_are_compared_in_blocks(spark, monkeypatch):
    """Without the stars that merge a crowd beforehand, its links come from blocks alone."""
    monkeypatch.setattr(jaccard_join, "_star_pairs", lambda rows, n_rows, threshold: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(jaccard_join, "CROWD", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 16)
    crowd = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join([*crowd[:i], f"y{i}", *crowd[i + 1 :]])) for i in range(60)]
    far = [f"c{i}" if i < 120 else f"f{i}" for i in range(200)]  # alike, but not enough
    rows += [(60 + i, " ".join([*far[:i], f"z{i}", *far[i + 1 :]])) for i in range(20)]
    assert near(spark, rows) == [(i, 0, 59) for i in range(60)] + [(60 + i, 60, 19) for i in range(20)]


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "b a"), (None, "a b"), (6, long), (7, long + " end"), (8, "!!"), (3, "a b")]
    assert near(spark, rows) == [(-1, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0)]
    assert near(spark, []) == []


def test_near_duplicates_do_not_depend_on_row_order(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "c d e f g h"), (4, "c d e f g h")]  # ids 1 and 4 repeat
    seen = [near(spark, random.Random(seed).sample(rows, len(rows))) for seed in range(3)]
    assert seen == [[(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (4, 4, 0)]] * 3
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample([*rows, (None, a), (None, None), (7, None), (7, None)], 10), "doc_id long, text string")
        kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(df.selectExpr("*", "1 as _id", "2 as text_hash")).collect()]
        assert sorted(kept, key=str) == sorted([(1, a), (1, b), (4, "c d e f g h"), (7, None), (None, a), (None, None)], key=str)


def test_near_duplicates_keep_the_type_of_ids(spark):
    df = spark.createDataFrame([("p", "a b c"), ("q", "A b, c"), ("r", "")], "doc_id string, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(df).collect()) == [("p", "p", 0), ("q", "p", 0), ("r", "r", 0)]


def test_recall_by_band(spark):
    rng, texts = random.Random(3), []
    for words in ([f"v{rng.randrange(10**6)}" for _ in range(150)] for _ in range(150)):
        texts.append(words)
        for n in (1, 2, 3):
            changed = list(words)
            for place in rng.sample(range(150), n):
                changed[place] = f"z{rng.randrange(10**6)}"
            texts.append(changed)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in rows]
    classes = dict((i, c) for i, c, _ in near(spark, rows))
    bands: dict[int, list[bool]] = {}
    for g in range(0, len(rows), 4):
        for x in range(g, g + 4):
            for y in range(x + 1, g + 4):
                s = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
                if s >= 0.8:
                    bands.setdefault(int(s * 20), []).append(classes[x] == classes[y])
    assert len(bands) >= 3
    assert all(np.mean(found) >= 0.97 for found in bands.values())


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_sketches_leave_pairs_at_any_threshold():
    assert jaccard_join.most_bits(0.8) == 32
    assert jaccard_join.most_bits(0.45) > 128 * 0.55 / 2 + 4 * math.sqrt(128 * 0.275 * 0.725)


def test_recall_bound():
    k = jaccard_join.shallowest()
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL
    assert 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES < jaccard_join.TARGET_RECALL


def brute(vectors, k):
    code = lambda v: [bool(x is not None and x == x and x > 0) for x in v]
    rows = [(i, code(v)) for i, v in vectors if i is not None and v is not None]
    out = {}
    for q, c in rows:
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in rows if i != q)[:k]
            out[q] = [(i, x) for x, i in near]
    return out


def test_search_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(10)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 420)]  # many equal vectors
    vectors += [(500, None), (550, [float("nan")] * 64), (551, [None] * 64)]
    path = str(tmp_path)
    spark.createDataFrame([*vectors, (None, vectors[1][1])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    got = {}
    for r in sorted(queries.op10_hamming_search(spark, path).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
    assert got == brute(vectors, 10)


def test_search_folds_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(4)
    for size in (40, 64, 150):
        vectors = [(i, rng.normal(size=size).round(3).tolist()) for i in range(60)]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as code", "3 as rank", "4 as distance", "'x' as segment")
        got = {}
        for r in sorted(hamming_search.top_k(df, df.filter("vec_id % 50 = 0"), k=5).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
        folded = [(i, [sum(v[b::64]) if b < size else 0.0 for b in range(64)]) for i, v in vectors]
        assert got == brute(folded, 5)


def test_search_over_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = hamming_search.top_k(df, df.filter("vec_id = 0"), k=3, bits=2).collect()
    assert [(r.neighbour_id, r.distance) for r in rows] == [(1, 1)]
    assert hamming_search.top_k(df.limit(0), df.limit(0)).count() == 0


def kept_by_brute_force(spark, name, rows, path):
    """Ids that a stage keeps of ``rows`` (doc_id, text, lang), by loops over texts with the models that it trains."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [t or "" for _, t, _ in rows]
    if name == "quality":
        model = quality_model.train(docs, common.read(spark, path, "labels").filter(common.id_bucket(3) != 1))
        return [i for (i, *_), score in zip(rows, model.score(np.array([quality_model.statistics(t) for t in texts])), strict=True) if score >= 0.5]
    if name == "language":
        model = langid.train(docs.filter(common.id_bucket(4) != 2))
        lattice, kept = langid.Lattice(list(model.pieces)), []
        for (i, *_), text in zip(rows, texts, strict=True):
            words = langid.words_of(text)
            if words:
                total = lattice.log_probability(words, model.probability).sum(axis=0)
                if 1 / np.exp(total - total.max()).sum() >= 0.5:
                    kept.append(i)
        return kept
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    class_of = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if rows[x][:2] == rows[y][:2] or (sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])):
                class_of = [class_of[y] if c == class_of[x] else c for c in class_of]
    return [min(rows[x][0] for x in range(len(rows)) if class_of[x] == c) for c in set(class_of)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "and", "tion", "er"], "de": ["der", "sch", "ung", "ich", "ver"]}
    rows, labels = [], []
    for i in range(200):
        lang = "en" if i % 3 else "de"
        words = ["".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 80))]
        good = i % 5 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + "***" for w in words), lang))
        labels.append((i, int(good), 0))
    rows += [(1000, rows[1][1], "en"), (1001, rows[1][1] + " more", "en"), (1002, None, None), (1003, "12 34", None), (1, rows[1][1], "en")]
    path = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "0 as score", "0 as lang_pred")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "score", "lang_pred"]
        seen.append(sorted(r.doc_id for r in docs.collect()))
        assert seen[-1] == sorted(kept_by_brute_force(spark, name, before, path))
    good = {i for i, q, _ in labels if q}
    assert good <= set(seen[0])
    assert not {i for i, q, _ in labels if not q} & set(seen[0])
    assert good <= set(seen[1])
    assert not {1002, 1003} & set(seen[1])
    assert seen[2] == sorted(good)
    model = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for packed in (corpus_pipeline.STAGES[-1][1](spark, docs, path).collect(), corpus_pipeline.run(spark, path).collect()):
        assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packed} == {(i, 0, len(x), crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
        for sequence in {r.sequence_id for r in packed}:
            place = 0
            for r in sorted((r for r in packed if r.sequence_id == sequence), key=lambda r: r.offset):
                assert r.offset == place
                place += r.length
            assert place <= 4096
        assert len({r.sequence_id for r in packed}) <= math.ceil(sum(r.length for r in packed) / 4096) + 1


def test_all_queries_over_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>"), ("conversations", "conv_id long, turn long, role string, text string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    for query in (*queries.QUERIES.values(), corpus_pipeline.run):
        assert query(spark, path).collect() == []


def test_clashing_columns_change_nothing(spark, tmp_path):
    """Extra columns with the names of results and inner columns."""
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choices(["the", "and", "der", "und", "MIT", "License", "#"], k=rng.randrange(3, 60))), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)], "vec_id long, embedding array<double>")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([(i // 4, i % 4, "user" if i % 3 else "assistant", f"text {i}.") for i in range(60)], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([(i, f"the und {i}") for i in range(5)], "item_id long, text string")
    found = []
    for extra in ((), ("score", "label", "node", "class_id", "piece", "length", "word", "n", "task", "code", "rank", "kept", "held_out", "lang_pred", "stats", "grams", "id", "comp", "_id", "copies", "symbols", "kind", "digest", "head", "terms", "tf", "part", "ids", "ends", "payload", "_row")):
        path = str(tmp_path / str(len(extra)))
        for name, df in (("documents", docs), ("embeddings", vectors), ("labels", labels), ("conversations", talks), ("benchmark", items)):
            df.selectExpr("*", *[f"'clash' as {c}" for c in extra]).write.parquet(f"{path}/{name}.parquet")
        found.append({name: sorted(map(str, query(spark, path).collect())) for name, query in queries.QUERIES.items() if name != "op8_best_fit_packing"})
        found[-1]["op8"] = sorted((r.doc_id, r.length, r.ids_crc32) for r in queries.op8_best_fit_packing(spark, path).collect())
    assert found[0] == found[1]
