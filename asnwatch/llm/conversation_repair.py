"""Repair of conversations at least cost: rows are kept, given another role, deleted, or inserted, until the initials of
the roles read ``(s?(ua)+)?``.

The roles and faults of a conversation are a string of symbols. Frequent pairs of symbols become rules of a grammar (Re-Pair, counted
over all conversations on Spark), each with one min-plus matrix over the four states of the pattern: least cost, and as a
rope the edits of that cost that are least in ASCII. A conversation is the product of its symbols' matrices, so what
conversations share is worked out once. Of edits of equal cost over the same rows none begins another, as a further letter
would be an insertion at a cost, so the least of a product is made of the least of its factors.

Contract for odd input: null roles and texts are one space, a null turn comes first and counts for no gap, rows of one
turn are ordered by role and text (its first HEAD characters, then a hash); a null conversation id is a
conversation; a role with another initial must change or go; rows that repeat are repeated; texts of any length are
hashed whole; a conversation whose rows have all gone has zeros, no edits and the hash of an empty text; an empty table
gives no rows. A conversation may hold any share of the rows: its symbols are gathered in fragments of FRAGMENT rows, one
letter a row as in its answer, and its texts pass the hash, which is a chain by nature, in order and one at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from asnwatch.llm.common import checkpointed

# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
HEAD = 16
FRAGMENT = 4096
#: Symbols under which pairs are counted together; rules of the grammar, those found in one count, and least uses of one.
CHUNK = 1024
MOST_RULES, PER_ROUND, LEAST_USES = 256, 64, 16
#: Distinct strings whose answers a task remembers, and symbols of a grammar that are multiplied one after the other.
REMEMBERED = 50_000
DIRECT = 64

#: States: nothing yet, after system, after user, after assistant. The first and last may end a conversation.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT_USER = {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}
_NEXT_ASSISTANT = {_USER: _ASSISTANT}
_AFTER = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_MUST_GO = "x"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of ``conversations``, damaged by crc32 of "conv_id:turn" modulo 20: 0 drops the
    row (no copies), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# Ropes and matrices

#: A rope is a text or a pair of ropes.
Rope = str | tuple
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += (x[1], x[0])


def flat(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def _letters(rope: Rope) -> Iterator[str]:
    for leaf in leaves(rope):
        yield from leaf


def _less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes before ``b``; read side by side up to the first difference."""
    while isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    return next((x < y for x, y in zip_longest(_letters(a), _letters(b), fillvalue="") if x != y), False)


def better(one: Entry | None, two: Entry | None) -> Entry | None:
    if one is None or two is None:
        return one or two
    if one[0] != two[0]:
        return min(one, two, key=lambda x: x[0])
    return two if _less(two[1], one[1]) else one


def _joined(one: Entry, two: Entry) -> Entry:
    if not one[1] or not two[1]:
        return one[0] + two[0], one[1] or two[1]
    return one[0] + two[0], (one[1], two[1])


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; equal costs are settled by the edits."""
    out: Matrix = []
    for row in left:
        line: list[Entry | None] = [None] * 4
        for k, head in enumerate(row):
            if head is not None:
                for j, tail in enumerate(right[k]):
                    if tail is not None:
                        line[j] = better(line[j], _joined(head, tail))
        out.append(line)
    return out


def inserted() -> Matrix:
    """Insertions between two rows: none, or those that lead from state to state."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        state, cost, said = i, 0, ""
        for _ in range(2):
            state, cost, said = (_NEXT_USER | _NEXT_ASSISTANT)[state], cost + INSERT, said + "I"
            out[i][state] = better(out[i][state], (cost, said))
    return out


def terminal(symbol: str) -> Matrix:
    """Insertions, then one row: s, u, a, o (another initial), in capitals if truncated, or one that must go."""
    role, more = symbol.lower(), TRUNCATED * symbol.isupper()
    row: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        row[i][i] = (DELETE, "D")
    if symbol != _MUST_GO:
        for kind, moves in (("u", _NEXT_USER), ("a", _NEXT_ASSISTANT), ("s", {_START: _SYSTEM})):
            for i, j in moves.items():
                if kind == role:
                    row[i][j] = better(row[i][j], (more, "K"))
                elif kind != "s":
                    row[i][j] = better(row[i][j], (REROLE + more, "R"))
    return times(inserted(), row)


class Grammar:
    """Rules (symbol, left, right) in the order of their use, and a matrix for each symbol, made bottom-up."""

    TERMINALS = "suaoSUAOx"

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.matrices = {x: terminal(x) for x in self.TERMINALS}
        for symbol, left, right in rules:
            product = times(self.matrices[left], self.matrices[right])
            self.matrices[symbol] = [[e and (e[0], flat(e[1])) for e in line] for line in product]
        self.last = inserted()
        self.known: dict[str, tuple[int, str]] = {}

    def compress(self, symbols: str) -> str:
        for symbol, left, right in self.rules:
            symbols = symbols.replace(left + right, symbol)
        return symbols

    def _product(self, symbols: str) -> Matrix:
        """Halves first, so that comparing edits costs no more than the length a level."""
        if len(symbols) == 1:
            return self.matrices[symbols]
        half = len(symbols) // 2
        product = times(self._product(symbols[:half]), self._product(symbols[half:]))
        return [[e and (e[0], flat(e[1])) for e in line] for line in product]

    def solve(self, symbols: str) -> tuple[int, str]:
        """Least cost and edits of a whole conversation."""
        if symbols not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.compress(symbols)
            vector: Matrix = [[(0, ""), None, None, None]]
            for each in (self.matrices[x] for x in found) if len(found) <= DIRECT else (self._product(found),):
                vector = times(vector, each)
            line = times(vector, self.last)[0]
            cost, edits = better(line[_START], line[_ASSISTANT])
            answer = cost, flat(edits)
            if len(symbols) > FRAGMENT:
                return answer
            self.known[symbols] = answer
        return self.known[symbols]


# Tables


def _schema(ddl: str, conv: str) -> str:
    return f"conv_id {conv}, {ddl}"


def _identity() -> list[Column]:
    """What rows of a turn are ordered by after their role: the beginning of the text, and a hash of conversation, role and text."""
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    return [F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2(F.concat(conv, F.lit("\0"), "role", F.lit("\0"), "text"), 256)).alias("digest")]


def _narrow(rows: DataFrame) -> DataFrame:
    """Each distinct row without its text: order, faults of its own, and copies."""
    solid = F.rtrim("text", F.lit(BLANKS))
    each = rows.select(
        "conv_id", "turn", "role", *_identity(),
        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut"), "copies",
    )
    return each.groupBy(*[c for c in each.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))


def _place(turn: str = "turn") -> Column:
    """Turns that can be compared, null first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def _fragments(rows: DataFrame) -> DataFrame:
    """Rows in order, up to FRAGMENT of a conversation in one row each: their symbols and counts, and what joins them to
    the fragments next to them."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "blank", "cut", "copies", "again")
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = _schema(f"nth long, symbols string, blank long, duplicate long, truncated long, illegal long, turns long, low {turn}, high {turn}, first string, last string", conv)
    kind = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = (TaskContext.get().partitionId() << 40) - 1
        done: list[tuple] = []
        now: list | None = None
        for batch in batches:
            for conv_id, turn, role, blank, cut, copies, again in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if now is None or now[0] != conv_id or len(now[2]) >= FRAGMENT:
                    if now:
                        done.append((*now[:2], "".join(now[2]), *now[3:]))
                    nth += 1
                    now = [conv_id, nth, [], 0, 0, 0, 0, 0, None, None, None, None]
                if not copies:
                    continue
                initial = role[:1]
                gone = blank or again
                symbol = (initial if initial in _AFTER else "o") if not gone else _MUST_GO
                now[2].append((symbol.upper() if cut and not gone else symbol) + _MUST_GO * (copies - 1))
                now[3] += copies if blank else 0
                now[4] += 0 if blank else copies if again else copies - 1
                now[5] += cut and not gone
                now[6] += copies - 1 + (now[11] is not None and now[11] + initial not in LEGAL)
                if turn is not None and turn != now[9]:
                    now[7] += 1
                    now[8], now[9] = turn if now[8] is None else now[8], turn
                now[10], now[11] = initial if now[10] is None else now[10], initial
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now[:2], "".join(now[2]), *now[3:]), kind, strict=True)], schema=kind)

    return dealt.mapInArrow(run, schema)


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _gathered(fragments: DataFrame) -> DataFrame:
    """One row for each conversation. What is gathered is a letter a row of it, as its answer holds, and a row a fragment."""
    conv = fragments.schema["conv_id"].dataType.simpleString()
    parts = fragments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in fragments.columns if c != "conv_id"]))).alias("parts"))
    counts = ("blank", "duplicate", "truncated", "illegal")
    schema = _schema("gaps long, blank long, duplicate long, truncated long, illegal long, symbols string", conv)
    kind = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                total, turns, low, high, last = Counter(), 0, None, None, None
                for p in parts:
                    total.update({c: p[c] for c in counts})
                    total["illegal"] += last is not None and p["first"] is not None and last + p["first"] not in LEGAL
                    last = last if p["last"] is None else p["last"]
                    turns += p["turns"] - (p["low"] is not None and p["low"] == high)
                    low, high = p["low"] if low is None else low, high if p["high"] is None else p["high"]
                gaps = 0 if low is None else int(high - low + 1 - turns)
                rows.append((conv_id, gaps, *(total[c] for c in counts), "".join(p["symbols"] for p in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)] if rows else [pa.array([], f.type) for f in kind], schema=kind)

    return parts.mapInArrow(run, schema)


def learn(strings: DataFrame, column: str = "symbols") -> list[tuple[str, str, str]]:
    """Rules of a grammar for strings of symbols. In each round tasks count the pairs of symbols, at most the square of the
    symbols there are, and the most frequent become rules; rules of one round are made by the counts of its beginning."""
    spread = strings.select(F.explode(F.regexp_extract_all(column, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("part"))
    parts = checkpointed(spread.groupBy("part").agg(F.count("*").alias("uses")))
    rules: list[tuple[str, str, str]] = []
    size = dict.fromkeys(Grammar.TERMINALS, 1)
    while len(rules) < MOST_RULES:
        so_far = list(rules)

        def count(batches: Iterator[pa.RecordBatch], so_far=so_far) -> Iterator[pa.RecordBatch]:
            grammar, pairs = Grammar([]), Counter()
            grammar.rules = so_far
            for batch in batches:
                for part, uses in zip(batch.column("part").to_pylist(), batch.column("uses").to_pylist(), strict=True):
                    found = grammar.compress(part)
                    for pair in map("".join, zip(found, found[1:], strict=False)):
                        pairs[pair] += uses
            yield pa.RecordBatch.from_arrays([pa.array(pairs.keys(), pa.string()), pa.array(pairs.values(), pa.int64())], names=["pair", "uses"])

        counted = parts.mapInArrow(count, "pair string, uses long").groupBy("pair").agg(F.sum("uses").alias("uses"))
        top = [r for r in counted.orderBy(F.desc("uses"), "pair").limit(PER_ROUND).collect() if r["uses"] >= LEAST_USES and size[r["pair"][0]] + size[r["pair"][1]] <= CHUNK]
        fresh = [r["pair"] for r in top if 16 * r["uses"] >= top[0]["uses"]]
        if not fresh:
            break
        for pair in fresh[: MOST_RULES - len(rules)]:
            symbol = chr(0x100 + len(rules))
            rules.append((symbol, *pair))
            size[symbol] = size[pair[0]] + size[pair[1]]
    return rules


def _solved(found: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add cost and audit. What is sent are MOST_RULES rules at most; each task makes their matrices."""
    schema = found.schema.simpleString()[7:-1].replace(":", " ").replace("symbols string", "cost long, audit string")
    kept = [c for c in found.columns if c != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            answers = [grammar.solve(x) for x in batch.column("symbols").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array([x[0] for x in answers], pa.int64()), pa.array([x[1] for x in answers], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "cost", "audit"])

    return found.mapInArrow(run, schema)


class _Repaired:
    """Lines of a repaired conversation, given row by row."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state, self.put = edits, 0, _START, None

    def _expected(self) -> tuple[str, int]:
        return ("assistant", _ASSISTANT) if self.state == _USER else ("user", _USER)

    def inserts(self) -> Iterator[str]:
        while self.edits[self.at : self.at + 1] == "I":
            role, self.state = self._expected()
            self.at += 1
            yield f"{role}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            role, self.state = self._expected()
            yield f"{role}:{text}"


def repair(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) to one row for each conversation: gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. Texts are shuffled once, behind the edits of their conversation."""
    narrow = _narrow(rows)
    seen = narrow.filter("copies > 0 and not blank").groupBy("digest").agg(F.min(_place()).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = F.coalesce(_place() > F.col("first"), F.lit(False))
    judged = narrow.join(seen.select("digest", "first"), "digest", "left").withColumn("again", again)
    found = checkpointed(_gathered(_fragments(judged)))
    answers = _solved(found, learn(found))

    order = ("turn", "role", "head", "digest")
    conv = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", *_identity(), "text", "copies")
    both = answers.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *[F.asc_nulls_first(c) for c in order])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = _schema(", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string", conv)
    kind = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        answer, lines, digest, begun = None, None, None, False

        def add(said: Iterator[str]) -> None:
            nonlocal begun
            for line in said:
                digest.update((b"\n" if begun else b"") + line.encode())
                begun = True

        def close() -> None:
            if answer:
                add(lines.inserts())
                done.append((*answer, digest.hexdigest()))

        for batch in batches:
            for is_row, role, text, copies, *values in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "copies", "conv_id", *counts, "audit")), strict=True):
                if not is_row:
                    close()
                    answer, lines, digest, begun = values, _Repaired(values[-1]), sha256(), False
                else:
                    for _ in range(copies):
                        add(lines.row(role, text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)

    return dealt.select("conv_id", "kind", "role", "text", "copies", *counts, "audit").mapInArrow(run, schema)
