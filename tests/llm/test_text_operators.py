import math
import random
import re
import time
from collections import Counter
from functools import lru_cache
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from asnwatch.llm import langid, licenses, packing, ppm, quality_model, quality_rules, queries, sentencepiece_fst, toxicity

ODD = [None, "", " ", "\n\n", "x", "word " * 30_000, "é" * 500, "日本語テキスト", "a\x00b", "🙂", "<|endoftext|> x", "İstanbul Σίσυφος"]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words long, score int")


def tables(spark, tmp_path, texts, **more):
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for name, df in more.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_contract(spark, tmp_path):
    texts = [*ODD, "Released under the MIT License. Under the mit-license!", "apache LICENSE, version 2.0 and CC BY-NC 4.0", "cc by nc by nc cc by ncx"]
    texts += ["// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nx", "SPDX-License-Identifier: MIT OR", "GNU General Public License, version 3."]
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, tables(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = words_of(text)
        starts = [(s, label) for phrase, label in licenses.BASE_PHRASES.items() for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in starts}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[len(texts) - 3].labels == "bsd,gpl-2,mit"
    assert got[len(texts) - 2].score == licenses.UNKNOWN
    assert got[len(texts) - 1].labels == "gpl-3"


def test_notices_by_brute_force():
    rng = random.Random(21)
    every = {**licenses.BASE_PHRASES, **licenses.NOTICE_PHRASES}
    vocabulary = [w for p in ("cc by nc sa", "gnu general public license version 2 3", "creative commons attribution sharealike") for w in p.split()]
    machine = licenses.automaton()
    for _ in range(200):
        words = rng.choices(vocabulary, k=40) + rng.choice(list(every)).split() + ["x"] + rng.choice(list(every)).split()
        spans = [(s, s + len(p.split()) - 1, label, p in licenses.BASE_PHRASES) for p, label in every.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        want = [x for x in spans if x[3] or not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in spans)]
        assert sorted(licenses.notices(f" {' '.join(words)} ", machine)) == sorted(want)


def test_license_scan_is_linear_in_notices(spark):
    rows = [(i, "cc by nc x " * n) for i, n in enumerate((1, 60_000))]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "size(spans) as n", "spans[size(spans) - 1] as last").collect()}
    assert (got[0].n, got[1].n, got[1].last["first"]) == (1, 60_000, 4 * 59_999)


def test_tags_on_one_line(spark):
    tag = "SPDX-License-Identifier: "
    texts = [f"{tag}MIT " * 60_000, f"{tag}MIT {tag}GPL-2.0 OR EPL-2.0 // {tag}MIT\n{tag}{tag}ISC", f"{tag}MIT OR {tag}Zlib", " ".join(f"{tag}x{i}" for i in range(20_000))]
    start = time.monotonic()
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts)).selectExpr("doc_id", "expression", "score", "labels").collect()}
    assert time.monotonic() - start < 30
    assert (got[0].expression, got[0].score, got[0].labels) == ("(mit)", 1.0, ["mit"])
    assert (got[1].expression, got[1].score, got[1].labels) == ("(mit) AND (gpl-2.0 or epl-2.0) AND (isc)", 0.7, ["epl", "gpl-2", "isc", "mit"])
    assert (got[2].expression, got[2].score) == ("(mit or) AND (zlib)", licenses.UNKNOWN)
    assert len(got[3].labels) == 20_000


def test_tags_give_expressions(spark):
    texts = ["/* SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception */", "é SPDX License\nIdentifier:\tZlib\nMIT", "spdx-license-identifier", "SPDX-License-Identifier: LGPL-2.1 OR MIT\r\nSPDX-License-Identifier: MPL-2.0"]
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert [got[i].labels for i in range(4)] == [["apache-2"], ["zlib"], [], ["lgpl", "mit", "mpl"]]
    assert [got[i].expression for i in range(4)] == ["(apache-2.0 with llvm-exception)", "(zlib)", None, "(lgpl-2.1 or mit) AND (mpl-2.0)"]


@pytest.mark.parametrize(
    ("expression", "postfix"),
    [("MIT", "MIT"), ("A or B and C", "A B C and or"), ("(A OR B) AND C", "A B or C and"), ("A WITH x OR B", "A x with B or"), ("A B", None), ("(A", None), ("A)", None), ("AND A", None), ("", None), ("()", None)],
)
def test_shunting_yard(expression, postfix):
    assert licenses.to_postfix(expression) == (postfix.split() if postfix else None)


def test_openness():
    assert licenses.openness("MIT OR GPL-3.0") == 1.0
    assert licenses.openness("MIT AND GPL-3.0") == 0.5
    assert licenses.openness("GPL-2.0 WITH Classpath-exception-2.0") == pytest.approx(0.7)


def test_quality_contract(spark, tmp_path):
    rng = random.Random(1)
    texts = [*ODD] + [" ".join(rng.choice("abcd") for _ in range(n)) for n in (7, 8, 9, 30, 200)] + ["p q r s t u v w\n" * 3, "x #*$\nx #*$\n \ny"]
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, tables(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {j + k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == base
        assert not (base and r.kept)


def test_policies_and_ablations(spark):
    entries = quality_rules.ledger(docs_of(spark, ["short", "a b " * 40, " ".join(f"word{i}" for i in range(50)), " ".join(f"w{i} #" for i in range(50))]))
    rows = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    kept = quality_rules.apply_policy(entries).filter("kept").count()
    assert all(r.n_kept == kept for r in rows.values())
    assert rows["too_few_words"].n_failed == 1
    without = quality_rules.Policy("x", 2, tuple(x for x in quality_rules.DEFAULT.rules if x != "symbols"))
    assert quality_rules.apply_policy(entries, without).filter("kept").count() == kept + rows["symbols"].n_failed_alone
    assert quality_rules.ledger(docs_of(spark, [])).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = sorted([bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab"])
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces), 2)) * 0.1
    lattice = langid.Lattice(pieces)
    number = {p: i for i, p in enumerate(pieces)}

    def brute(word, lang):
        return 1.0 if not word else sum(prob[number[word[:n]], lang] * brute(word[n:], lang) for n in range(1, len(word) + 1) if word[:n] in number)

    words = [b" abc", b" a", b"abcabc", b" x", b"abab", b"abcbcababcab" * 3]  # the last is longer than a rescaled stretch
    brute = lru_cache(None)(brute)
    got = lattice.log_probability(words, prob)
    want = np.log([[brute(w, k) for k in range(2)] for w in words])
    assert np.allclose(got, want)
    # Expected uses of a piece: the derivative of the log probability by the log of its probability.
    weight = np.ones((len(words), 2))
    counts = lattice.expected_counts(words, weight, prob)
    i = number[b"ab"]
    more = prob.copy()
    more[i] *= 1 + 1e-6
    assert np.allclose(counts[i], (lattice.log_probability(words, more) - got).sum(axis=0) / 1e-6, rtol=1e-3)


def test_long_words_are_summed_whole():
    """A word's probability by a plain forward algorithm in logarithms, over more bytes than doubles could hold."""
    pieces = sorted([bytes([b]) for b in range(256)] + ["до".encode(), "примеч".encode(), " дост".encode(), "ательностями".encode()])
    prob = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    number = {p: i for i, p in enumerate(pieces)}
    for word in ("достопримечательностями", "достопримечательностями" * 40):
        raw = b" " + word.encode()
        total = np.full((len(raw) + 1, 2), -np.inf)
        total[0] = 0
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - 24), end):
                if raw[start:end] in number:
                    total[end] = np.logaddexp(total[end], total[start] + np.log(prob[number[raw[start:end]]]))
        assert np.allclose(langid.Lattice(pieces).log_probability([b" x", raw], prob)[1], total[-1])
        counts = langid.Lattice(pieces).expected_counts([raw], np.ones((1, 2)), prob)
        assert np.allclose((counts * np.array([len(p) for p in pieces])[:, None]).sum(axis=0), len(raw))


def test_long_words_teach(spark):
    pieces = sorted([bytes([b]) for b in range(256)] + [b"ab", b"qz", b" qz"])
    prob = np.full((len(pieces), 2), 1e-7)
    prob[pieces.index(b"ab")] = 0.9  # half the word is likely, half is not: plain sums leave the range of doubles either way
    word = b" " + b"ab" * 6000 + b"qz" * 6000
    counts = langid.Lattice(pieces).expected_counts([b" ab", word], np.array([[1.0, 0.0], [2.0, 1.0]]), prob)
    assert np.allclose((counts * np.array([len(p) for p in pieces])[:, None]).sum(axis=0), [3 + 2 * len(word), len(word)])
    assert np.allclose(counts[pieces.index(b"ab")], [12_001, 6000], rtol=1e-3)
    rows = [(0, "qz" * 9000, "xx"), (1, "the word and the other", "en"), (2, "and the next", "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(9, "qzqz"), (8, "the")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {9: "xx", 8: "en"}


def test_language_contract(spark, tmp_path):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "tion"], "de": ["der", "sch", "ung", "ich"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(20)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(1000 + i, t, None if i % 2 else "en") for i, t in enumerate([None, "", "123 !!", "x" * 400])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_language_id(spark, str(tmp_path)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(docs_of(spark, ["abc"]), nothing).first().lang_pred == "und"


def labelled(spark, tmp_path, n=240):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(rng.randrange(5, 60))]
        if toxic:
            words[rng.randrange(len(words))] = "Horrid!"
        good = i % 3 != 0
        texts.append(" ".join(words) if good else " ".join(w + "***" for w in words))
        labels.append((i, int(good), int(toxic)))
    extra = [*ODD]
    return tables(spark, tmp_path, texts + extra, labels=spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")), labels, len(texts) + len(extra)


def test_toxicity_and_quality_contract(spark, tmp_path):
    sf_dir, labels, total = labelled(spark, tmp_path)
    for f, column, cut in ((queries.op4_toxicity, 2, 0.7), (queries.op5_quality_model, 1, 0.5)):
        got = {r.doc_id: r for r in f(spark, sf_dir).collect()}
        assert len(got) == total
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got.values())
        held = [x for x in labels if got[x[0]].held_out]
        assert sum(got[x[0]].predicted == x[column] for x in held) >= 0.95 * len(held)


def test_models_without_rows(spark):
    none, docs = spark.createDataFrame([], "doc_id long, quality int, toxic int"), docs_of(spark, ["a b", None])
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    assert [r.score for r in quality_model.score(docs, quality_model.train(docs, none)).collect()] == [0.5, 0.5]


def test_ftrl_against_one_coordinate_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARDS", 1)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["vile", "calm", "sea", "sky", "tree", "stone"][(0 if i % 4 == 0 else 1) :]) for _ in range(8))) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string")  # one row twice
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, epochs=3)

    features = {i: sorted(set(toxicity.grams([t])[0].tolist())) for i, t in rows}
    held = Counter(h for f in features.values() for h in f)
    prior = 15.5 / 61
    z, n = {"bias": -math.log(prior / (1 - prior)) * (toxicity.BETA + 1) / toxicity.ALPHA}, {"bias": 1.0}

    def weight(k):
        l1 = 0.0 if k == "bias" else toxicity.L1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA)

    for epoch in range(3):
        for i in sorted(features, key=lambda i: crc32(f"{epoch} {i}".encode())):
            keys = [*features[i], "bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - int(i % 4 == 0)
            for k in keys:
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / toxicity.ALPHA * w[k]
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want)
    assert model.bias == pytest.approx(weight("bias"))


def test_grams_of_one_text_are_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.01)
    rows = [(i, f"only{i} here{i} {'bad thing' if i % 2 else 'good thing'}") for i in range(40)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), epochs=2)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    for i, text in rows:
        own = {round(weights.get(h, 0.0), 9) for h in set(toxicity.grams([text])[0].tolist()) & set(toxicity.grams([f"only{i} here{i}"])[0].tolist())}
        assert len(own) == 1 and (own.pop() > 0) == (i % 2 == 1)
    assert (np.diff(model.hashes.astype(np.int64)) > 0).all()
    few = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), epochs=1, sample_bytes=200)
    assert len(few.hashes) < len(model.hashes) / 2


def test_quality_model_against_one_solution(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["good", "words", "#$%", "A!"][: 2 if i % 3 else 4]) * rng.randrange(1, 4) for _ in range(rng.randrange(5, 40)))) for i in range(90)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    part = {r.doc_id: r.p for r in labels.select("doc_id", (F.floor(quality_model.hash_fraction("doc_id") * 1_000_003) % quality_model.CALIBRATION).alias("p")).collect()}
    x, y = np.array([quality_model.statistics(t) for _, t in rows]), np.array([float(i % 3 > 0) for i, _ in rows])
    rng = np.random.default_rng(quality_model.SEED)
    frequencies, phases = rng.normal(0, quality_model.SCALE, (x.shape[1], quality_model.FEATURES)), rng.uniform(0, 2 * np.pi, quality_model.FEATURES)
    deviation = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    features = lambda x: np.hstack([np.cos(np.clip((x - x_mean) / deviation, -8, 8) @ frequencies + phases) * np.sqrt(2 / quality_model.FEATURES), np.ones((len(x), 1))])
    x_mean = x.mean(axis=0)
    fits = np.array([part[i] != 0 for i, _ in rows])
    f = features(x[fits])
    penalty = np.eye(f.shape[1]) * quality_model.RIDGE
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(f.T @ f + penalty, f.T @ y[fits])
    assert np.allclose(features(x) @ weights, model.raw(x), atol=1e-5)
    # Calibration: the levels are the isotonic fit of the bins' means, found here by the min-max formula.
    bins = np.floor(np.clip(features(x[~fits]) @ weights, -0.5, 1.5) * quality_model.BINS / 2)
    found = sorted(set(bins))
    mean = lambda a, b: y[~fits][np.isin(bins, found[a : b + 1])].mean()
    levels = [max(min(mean(a, b) for b in range(k, len(found))) for a in range(k + 1)) for k in range(len(found))]
    assert np.allclose(levels, model.levels)
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert np.allclose([got[i] for i, _ in rows], np.interp(model.raw(x), (np.array(found) + 0.5) * 2 / quality_model.BINS, levels) * 0.99 + np.clip(model.raw(x), 0, 1) * 0.01)


def test_isotonic():
    y = quality_model.isotonic(np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.ones(5))
    assert y.tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]


def test_transducer_against_library():
    import sentencepiece

    path = sentencepiece_fst.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = sentencepiece_fst.PieceTransducer(path)
    rng = random.Random(4)
    texts = [t or "" for t in ODD if t is None or len(t) < 2000]
    texts += ["".join(rng.choices("ab cde.tion  é\n\t日", k=rng.randrange(1, 40))) for _ in range(300)] + ["for (int i=0; i<10; i++) {\n\treturn;\n}", "    indented   text ", "https://a.b/c?d=e"]
    for text in texts:
        ids = machine.encode(text).tolist()
        assert ids == library.encode(text)
        assert machine.decode(np.array(ids, dtype=np.int64)) == text


def test_sentencepiece_query(spark, tmp_path):
    rows = queries.op7_sentencepiece(spark, tables(spark, tmp_path, ODD)).collect()
    assert all(r.round_trip for r in rows)
    assert {r.n_ids for r in rows if r.doc_id < 2} == {0}
    encoded = sentencepiece_fst.encode(docs_of(spark, ["a b", None]))
    assert [r.text for r in sentencepiece_fst.decode(encoded).orderBy("doc_id").collect()] == ["a b", ""]


def test_packing_contract(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [*ODD] + [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randrange(1, 900))) for _ in range(150)] + ["don't WON'T I'm ½² 3rd"]
    rows = queries.op8_best_fit_packing(spark, tables(spark, tmp_path, texts)).collect()
    model = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, text in enumerate(texts):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[i, piece] = (start, len(part), crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    total = 0
    for sequence in {r.sequence_id for r in rows}:
        place = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 4096
        total += place
    assert len({r.sequence_id for r in rows}) <= math.ceil(total / 4096) + 1


@pytest.mark.parametrize("seed", range(20))
def test_packing_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < rng.random())
    plan = packing.packing_plan(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    for lengths, n in plan:
        assert sum(lengths) <= capacity
        assert n > 0
        for x in lengths:
            used[x] += n
    assert used.tolist() == counts.tolist()


@pytest.mark.parametrize("seed", range(10))
def test_sum_index_against_all_combinations(seed):
    rng = random.Random(seed)
    counts = np.array([0, *(rng.choice([0, 0, 0, 1, 2]) for _ in range(25))])
    index = packing.SumIndex(counts)
    while counts.any():
        pool = [x for x in range(len(counts)) for _ in range(counts[x])]
        sums = {sum(c): len(c) for k in (3, 2, 1) for c in combinations(pool, k)}
        for total in range(1, len(counts)):
            found = index.find(total)
            assert (found is None) == (total not in sums)
            assert found is None or (sum(found) == total and len(found) == sums[total] and not Counter(found) - Counter(pool))
        counts[rng.choice(pool)] -= 1  # the index follows what is taken


def test_ppm_table_against_trie(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abé c", k=rng.randrange(0, 30))) for _ in range(40)] + [None]
    trie = ppm.ContextTrie()
    for text in texts:
        raw = (text or "").encode()
        history = bytes([ppm.EDGE] * ppm.ORDER)
        for symbol in [*raw, ppm.EDGE]:
            trie.learn(history, symbol)
            history = (history + bytes([symbol]))[1:]
    model = ppm.byte_model(ppm.gram_counts(docs_of(spark, texts)))
    asked = ["abc", "é a", "zzz", "", "a" * 50, "日"]
    assert np.allclose(model.log10_probability(asked), [trie.log10_probability(t) for t in asked], rtol=1e-5)
    total = sum(trie.probability(b"\xffab", s) for s in range(256))
    assert total == pytest.approx(1)
    assert ppm.ContextTrie().log10_probability("abababab" * 9, adaptive=True) > 30 * ppm.ContextTrie(0).log10_probability("a")


def test_ppm_scores_in_contexts_beyond_the_table(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CONTEXTS", (1, 256, 65_536, 8))
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdé fg", k=rng.randrange(0, 40))) for _ in range(60)] + [None, "zz", "日本"]
    trie = ppm.ContextTrie()
    for text in texts[:50]:
        raw = (text or "").encode()
        history = bytes([ppm.EDGE] * ppm.ORDER)
        for symbol in [*raw, ppm.EDGE]:
            trie.learn(history, symbol)
            history = (history + bytes([symbol]))[1:]
    assert sum(len(c) == ppm.ORDER for c in trie.counts) > 100
    got = {r.doc_id: r.score for r in ppm.score(docs_of(spark, texts), F.col("doc_id") < 50).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([trie.log10_probability(t or "") for t in texts], rel=1e-5)


def test_lm_contract(spark, tmp_path):
    rng = random.Random(7)
    texts = [*ODD] + [" ".join(rng.choice(["Alpha", "beta", "gamma", f"rare{i}"]) for _ in range(20)) for i in range(100)]
    got = {r.doc_id: r for r in queries.op9_ppm_scoring(spark, tables(spark, tmp_path, texts)).collect()}
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    held = {i: crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(texts):
        w = tokens(text)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score <= 0


def test_lm_without_training_rows(spark):
    docs = docs_of(spark, ["ab", None])
    rows = {r.doc_id: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert (rows[0].n_tokens, rows[0].n_known, rows[0].train_tokens) == (2, 0, 0)
    assert rows[0].score == pytest.approx(-3 * math.log10(256))
    assert rows[1].score == pytest.approx(-math.log10(256))


def test_lm_adaptive_score(spark):
    texts = ["abababababab" * 5, "the cat", "", None]
    got = {r.doc_id: r for r in ppm.adaptive_score(docs_of(spark, texts)).collect()}

    def coded(text):  # escapes and exclusion worked out anew from all that came before
        raw, total = [255] * 3 + list((text or "").encode()) + [255], 0.0
        for at in range(3, len(raw)):
            p, out = 1.0, set()
            for n in (3, 2, 1, 0):
                seen = Counter(raw[i] for i in range(3, at) if raw[i - n : i] == raw[at - n : at] and raw[i] not in out)
                if raw[at] in seen:
                    p *= seen[raw[at]] / (seen.total() + len(seen))
                    break
                if seen:
                    p *= len(seen) / (seen.total() + len(seen))
                    out |= set(seen)
            else:
                p /= 256 - len(out)
            total += math.log10(p)
        return total

    assert [got[i].score for i in range(4)] == pytest.approx([coded(t) for t in texts])
    assert [got[i].n_symbols for i in range(4)] == [61, 8, 1, 1]
