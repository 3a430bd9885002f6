"""Licence scan: notice phrases and identifier tags found by one Aho-Corasick pass,
licence expressions parsed with a shunting-yard parser.

Contract for odd input: a null or empty text has no words and no notices; repeated rows are scanned alike; long
texts are scanned whole, in time that grows with their length; a further notice inside a longer one does not
count, a base phrase always does; a malformed expression keeps its identifiers as labels and counts as
unknown; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from asnwatch.llm.common import map_texts, texts_of

# Phrases whose places are the base result.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "apache license 2 0": "apache-2",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "sil open font license": "ofl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu gpl": "gpl",
    "gnu gpl v2": "gpl-2",
    "gnu gpl v3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "european union public license": "eupl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 3": "cc-by",
    "cc by 4": "cc-by",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Families of licence identifiers, by prefix.
FAMILIES = {
    "mit": "mit",
    "apache-2": "apache-2",
    "bsd": "bsd",
    "0bsd": "bsd",
    "isc": "isc",
    "zlib": "zlib",
    "bsl": "bsl",
    "artistic": "artistic",
    "afl": "afl",
    "psf": "psf",
    "python": "psf",
    "ms-pl": "ms-pl",
    "ofl": "ofl",
    "gpl": "gpl",
    "gpl-2": "gpl-2",
    "gpl-3": "gpl-3",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "gfdl": "gfdl",
    "mpl": "mpl",
    "epl": "epl",
    "eupl": "eupl",
    "cddl": "cddl",
    "cpl": "cpl",
    "cc-by": "cc-by",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
    "cc-by-nc": "cc-by-nc",
    "cc0": "cc0",
    "unlicense": "public-domain",
    "wtfpl": "public-domain",
}
# How freely a text may be used, 1 is freely.
OPENNESS = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "psf": 1.0, "afl": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "ms-pl": 0.9, "ofl": 0.9, "artistic": 0.8, "mpl": 0.7, "epl": 0.7, "cpl": 0.7, "cddl": 0.7, "lgpl": 0.7,
    "eupl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "gpl-2": 0.5, "gpl-3": 0.5, "gfdl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.3
#: What an exception adds to the openness of the licence that it modifies.
EXCEPTION_BONUS = 0.2

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_SCHEMA = "n_words long, spans array<struct<first:long,last:long,label:string,base:boolean>>, labels array<string>, expression string, score double"


def word_table() -> bytes:
    """Byte map: letters to lower case, other ASCII outside 0-9 to a space, the rest as it is."""
    return bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@lru_cache(10_000)
def family(identifier: str) -> str:
    """The family with the longest prefix of the identifier, else the identifier itself."""
    key = identifier.lower()
    return next((FAMILIES[p] for p in sorted(FAMILIES, key=len, reverse=True) if key.startswith(p)), key)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: WITH binds before AND, AND before OR; None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low == "(":
            if not operand_next:
                return None
            stack.append("(")
        elif low == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def openness(expression: str) -> float:
    """OR takes the freer side, AND the stricter one, WITH adds EXCEPTION_BONUS; UNKNOWN if malformed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return UNKNOWN
    stack: list[float] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "or" else min(left, right) if token == "and" else min(1.0, left + EXCEPTION_BONUS))
        else:
            stack.append(OPENNESS.get(family(token), UNKNOWN))
    return stack[0]


def identifiers(expression: str) -> list[str]:
    """Licence names of an expression, those of exceptions left out."""
    names, previous = [], ""
    for token in _TOKEN.findall(expression):
        if token not in "()" and token.lower() not in _RANK and previous != "with":
            names.append(token)
        previous = token.lower()
    return names


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase, label, True))
    for phrase, label in NOTICE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase, label, False))
    found.add_word(f" {TAG} ", (TAG, "", False))
    found.make_automaton()
    return found


def notices(line: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, str, bool]]:
    """(first word, last word, label, base) of every phrase in ``line``, words with a space around each. The places come
    from one running count of the words. Without a label it is a tag."""
    found, words, at = [], 0, 0
    for end, (phrase, label, base) in machine.iter(line):
        words += line.count(" ", at, end)  # the phrase's last word is the last one before ``end``
        at = end
        found.append((words - 1 - phrase.count(" "), words - 1, label, base))
    kept, reach, before = [], -1, -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        inside = x[1] <= reach and (x[0], x[1]) != (before, reach)
        if x[3] or not inside:
            kept.append(x)
        if x[1] > reach:
            before, reach = x[0], x[1]
    return kept


def expressions(raw: bytes, spaced: bytes, tags: list[tuple[int, int]]) -> list[str]:
    """What stands behind each of the ``tags`` (first and last word) on its line, up to the next tag; each once. ``spaced``
    is ``raw`` with spaces for all that is in no word, byte for byte."""
    letter = np.frombuffer(spaced, np.uint8) != 0x20
    ends = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
    starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    nexts = [*starts[[first for first, _ in tags[1:]]].tolist(), len(raw)]
    out = []
    for start, limit in zip(ends[[last for _, last in tags]].tolist(), nexts, strict=True):
        stop = raw.find(b"\n", start, limit)
        out.append(raw[start : limit if stop < 0 else stop])
    return list(dict.fromkeys(x.decode("utf-8", "replace").lower().lstrip(" \t:").rstrip("*/-# .;,\t\r") for x in dict.fromkeys(out)))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, spans (first and last word of every notice, its
    label, whether it is a base phrase), labels, the combined expression and its openness from 0 to 1
    (0 if the text has no notice). Notices of one text combine with AND. A map over rows, no shuffle."""

    def make():
        table, machine = word_table(), automaton()

        def each(batch: pa.RecordBatch) -> dict:
            rows: dict[str, list] = {n: [] for n in ("n_words", "spans", "labels", "expression", "score")}
            for text in texts_of(batch, text_column):
                raw = text.encode("utf-8", "surrogatepass")
                spaced = raw.translate(table)
                words = spaced.split()
                found = notices(f" {b' '.join(words).decode('utf-8', 'surrogatepass')} ", machine)
                terms = dict.fromkeys(x[2] for x in found if x[2])
                labels = set(terms)
                if tags := [x[:2] for x in found if not x[2]]:
                    for said in expressions(raw, spaced, tags):
                        if names := identifiers(said):
                            terms[f"({said})"] = None
                            labels |= {family(x) for x in names}
                rows["n_words"].append(len(words))
                rows["spans"].append([dict(zip(("first", "last", "label", "base"), x, strict=True)) for x in found if x[2]])
                rows["labels"].append(sorted(labels))
                rows["expression"].append(" AND ".join(terms) or None)
                rows["score"].append(min(map(openness, terms), default=0.0))
            return {id_column: batch.column(id_column)} | rows

        return each

    kept = docs.select(id_column, text_column)
    return map_texts(kept, make, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, {_SCHEMA}", text_column)
