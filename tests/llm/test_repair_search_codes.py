"""Conversation repair, lexical search and token codes against brute force and round trips."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from asnwatch.llm import conversation_repair, lexical_search, queries, token_codes

BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"user": {0: 2, 1: 2, 3: 2}, "assistant": {2: 3}}


def cheapest(rows):
    """(cost, edits, lines) of rows (role, text, must go, truncated): every edit from every place, least cost and edits first."""
    done, heap = set(), [(0, "", 0, 0, ())]
    while heap:
        cost, edits, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, edits, lines
        for role, moves in NEXT.items():
            if state in moves:
                heapq.heappush(heap, (cost + 2, edits + "I", at, moves[state], (*lines, f"{role}:")))
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, state, lines))
            if not must_go:
                kept = {"s": {0: 1}, "u": NEXT["user"], "a": NEXT["assistant"]}.get(role[:1], {})
                if state in kept:
                    heapq.heappush(heap, (cost + truncated, edits + "K", at + 1, kept[state], (*lines, f"{role}:{text}")))
                for other, moves in NEXT.items():
                    if state in moves:
                        heapq.heappush(heap, (cost + 2 + truncated, edits + "R", at + 1, moves[state], (*lines, f"{other}:{text}")))


def repaired(rows):
    """The whole contract for (conv_id, turn, role, text) rows."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        of[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in of.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, faults = set(), [], Counter()
        for _, role, text in mine:
            solid = BLANK.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine"
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, lines = cheapest(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run_repair(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies long, symbols string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("fragment", [4096, 3])
def test_repair_by_brute_force(spark, tmp_path, monkeypatch, fragment):
    monkeypatch.setattr(conversation_repair, "FRAGMENT", fragment)
    monkeypatch.setattr(conversation_repair, "LEAST_USES", 2)
    rng = random.Random(3)
    texts = ["Yes.", "No", "What? ", "", " \n", "a.b", "é!", "same text.", "same text, longer", None, "x\x0b"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "a", "User"]
    rows = []
    for conv in [*range(120), None]:
        tidy = rng.random() < 0.5
        for turn in range(rng.randrange(1, 14)):
            role = ("user", "assistant")[turn % 2] if tidy and rng.random() < 0.9 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None, 5]), role, rng.choice(texts) if rng.random() < 0.4 else f"text {turn}{rng.choice('.!? x')}"))
    rows += [(900, None, None, None)] * 3 + [(901, k, "user", "again.") for k in range(30)] + [(902, 7, "assistant", "twice.")] * 9
    rng.shuffle(rows)
    assert run_repair(spark, tmp_path, rows) == repaired(rows)


def test_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_repair, "FRAGMENT", 100)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(900)}{rng.choice('. ')}") for t in range(2500)] + [(2, 0, "user", "Hi.")]
    assert run_repair(spark, tmp_path, rows) == repaired(rows)


def test_no_conversation_and_none_left(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert run_repair(spark, tmp_path / "a", []) == {}
    gone = [(c, 0, "user", "x") for c in range(200) if crc32(f"{c}:0".encode()) % 20 == 0]
    got = run_repair(spark, tmp_path, gone)
    assert len(got) == len(gone) and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_grammar_changes_no_answer():
    rng = random.Random(5)
    grammar = conversation_repair.Grammar([("Ā", "u", "a"), ("ā", "Ā", "Ā"), ("Ă", "x", "x"), ("ă", "U", "A"), ("Ą", "ā", "x")])
    plain = conversation_repair.Grammar([])
    letter = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in [*range(14)] * 40 + [300]:
        symbols = "".join(rng.choices("suaoSUAOxuaua", k=n))
        want = cheapest([(letter.get(x.lower(), ""), "", x == "x", int(x.isupper())) for x in symbols])[:2]
        assert grammar.solve(symbols) == plain.solve(symbols) == want
    assert len(grammar.compress("uaua" * 100)) == 100


def test_frequent_pairs_become_rules(spark):
    df = spark.createDataFrame([("uaua" * 5,)] * 30 + [("suax",)] * 20 + [("",)], "symbols string")
    rules = conversation_repair.learn(df)
    assert ("u", "a") in [r[1:] for r in rules] and len(rules) > 2
    assert len(conversation_repair.Grammar(rules).compress("uaua" * 5)) < 10


# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [x for x in bags if x[1]]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in wanted if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


WORDS = ["the", "The", "of", "Éa", "éa", "x1", "1x", "日本", "naïve", "zz", "a", "İ", "ſ"]


def search_tables(spark, tmp_path, docs, items):
    spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, score long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("lot", [200_000, 4])
def test_search_by_brute_force(spark, tmp_path, monkeypatch, lot):
    monkeypatch.setattr(lexical_search, "LOT_TERMS", lot)
    monkeypatch.setattr(lexical_search, "POOL", 16)
    rng = random.Random(6)
    say = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", ",", "\n", " - ", "_", "\x7f"]) for _ in range(k))
    docs = [(i, say(rng.randrange(0, 30))) for i in range(300)] + [(i, "the copy of zz") for i in range(300, 420)]
    docs += [(500, None), (501, ""), (502, "zz " * 50_000), (None, "the zz"), (7, "the same id, x1"), (503, "\x00the\x00")]
    items = [(i, say(rng.randrange(1, 6))) for i in range(9)] + [(20, None), (21, "unheard of"), (22, "!"), (3, "x1 again"), (None, "zz")]
    rng.shuffle(docs)
    got = queries.op12_lexical_search(spark, search_tables(spark, tmp_path, docs, items)).collect()
    want = ranked(docs, items)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_search_in_empty_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert queries.op12_lexical_search(spark, search_tables(spark, tmp_path / "a", [], [(1, "x")])).collect() == []
    assert queries.op12_lexical_search(spark, search_tables(spark, tmp_path, [(1, "x")], [])).collect() == []


# Token codes


def test_codes_give_back_every_id():
    rng = random.Random(7)
    for n in (0, 1, 7, 8, 9, 511, 512, 513, 5000):
        ids = np.array([rng.choice([rng.randrange(256), rng.randrange(50257), rng.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        codes = token_codes.Codes(token_codes.encode(ids))
        assert len(codes) == n and (codes.part(0, n) == ids).all()
        for _ in range(60 if n else 0):
            place, (a, b) = rng.randrange(n), sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            assert codes[place] == ids[place] and (codes.part(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        token_codes.Codes(token_codes.encode(np.array([1, 2])))[2]
    with pytest.raises(ValueError, match="not a payload"):
        token_codes.Codes(b"PAR1....")


def test_byte_tokenizer_equals_library():
    rng = random.Random(8)
    plain = [" ", " ", " ", "\n", "\t", "\r", "a", "B", "é", "²", "1", "23", "'s", "'", "'t", "t", "''", "l'm", "'re", "don't", "!", "..", "<", "|", "the", "Word", "ª"]
    odd = ["<|endoftext|>", "\x01", "\x02", "日", "\xa0", "🙂", "\x85"]
    texts = ["".join(rng.choice(plain if rng.random() < 0.98 else odd) for _ in range(rng.randrange(0, 25))) for _ in range(20_000)] + [" ".join(["word"] * 9999)]
    model = token_codes.ByteTokenizer(token_codes.tokenizer_path())
    got = model.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [x.ids for x in model.model.encode_batch_fast(texts, add_special_tokens=False)]


def test_files_hold_every_document_in_order(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " ", "x", "word " * 30_000, "日本語", "a\x00b", "<|endoftext|> x"] + [" ".join(rng.choices(["one", "two's", "three,", "\n\nFour"], k=rng.randrange(40))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, "again"), (None, "no id")]
    rng.shuffle(docs)
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ids string").repartition(7)
    token_codes.write_documents(df, path, size=500)
    got = sorted(token_codes.read_documents(spark, path).collect(), key=lambda r: r.start)
    model = token_codes.ByteTokenizer(token_codes.tokenizer_path()).model
    ids = {i: [] for i, _ in docs}
    for i, t in docs:
        ids[i].append([*model.encode(t or "", add_special_tokens=False).ids, 0])
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: -1 if i is None else i)
    start, every = 0, []
    for r in got:
        mine = next(x for x in ids[r.doc_id] if crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(mine)
        assert (r.start, r.n_tokens) == (start, len(mine))
        start += len(mine)
        every += mine
    asked = [0, 1, len(every) - 1, len(every), *rng.choices(range(len(every)), k=200)]
    found = token_codes.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert {r.position: r.token for r in found} == {p: every[p] for p in asked if p < len(every)}


def test_files_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op13_token_codes(spark, str(tmp_path)).collect() == []
