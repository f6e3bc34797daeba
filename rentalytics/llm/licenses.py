"""License scans: phrases and identifier tags found by one Aho-Corasick pass each, tag expressions evaluated.

Words and phrases meet in a text of the words joined by single blanks, so that one automaton finds every phrase at
word limits. Identifier tags are found in the lower-cased text itself; what follows a tag up to the end of its line is
read as a licence expression (``and``, ``or``, ``with``, brackets) by a shunting-yard parser and evaluated into the
sets of licences a user may choose from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, read

# Fixed values of the scan. Words: runs of anything but ASCII other than digits and letters, after A-Z is lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of this scan (as words), and the licence each one names.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
}
# Identifier tags, as written after A-Z is lowered.
TAGS = ("spdx-license-identifier:",)
# Licence identifiers by their beginning; a longer beginning wins. Others are labelled by themselves.
FAMILIES = {
    "mit": "mit", "apache-": "apache", "gpl-": "gpl", "lgpl-": "lgpl", "agpl-": "agpl", "bsd-": "bsd", "0bsd": "bsd",
    "mpl-": "mpl", "epl-": "epl", "bsl-": "bsl", "isc": "isc", "unlicense": "unlicense", "cc-by-": "cc-by",
    "cc0-": "cc0", "zlib": "zlib",
}
# Weight of one piece of evidence in the score: score = 1 - prod(1 - weight) over all found.
WEIGHTS = {"base": 0.5, "notice": 0.8, "tag": 0.95}
_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("expressions", T.StringType()),
])


@dataclass
class Found:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: str


def family(identifier: str) -> str:
    """Label of one licence identifier: its family by the longest known beginning, else the identifier."""
    best = ""
    for start in FAMILIES:
        if identifier == start or (start.endswith("-") and identifier.startswith(start)):
            best = max(best, start, key=len)
    if not best and identifier.startswith("mit"):
        best = "mit"
    return FAMILIES[best] if best else identifier.rstrip("+")


def parse(expression: str) -> list[str] | None:
    """Tokens of the expression in postfix order (shunting yard); None if it is not well formed.

    The expression ends where no token can be read. ``with`` binds closer than ``and``, ``and`` than ``or``.
    """
    tokens, at = [], 0
    while (m := _TOKEN.match(expression, at)) is not None:
        tokens.append(m.group(1))
        at = m.end()
    out: list[str] = []
    ops: list[str] = []
    want_operand = True
    for tok in tokens:
        if tok == "(":
            if not want_operand:
                break
            ops.append(tok)
        elif tok == ")":
            if want_operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break  # a closing bracket of the text around the expression ends it
            ops.pop()
        elif tok in _PRECEDENCE:
            if want_operand:
                return None
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[tok]:
                out.append(ops.pop())
            ops.append(tok)
            want_operand = True
            continue
        else:
            if not want_operand:
                break  # two operands in a row: the expression ended before the second
            out.append(tok)
        want_operand = tok == "("
    if want_operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]] | None:
    """The choices an expression leaves: ``or`` joins the choices of both sides, ``and`` takes one of each together,
    ``with`` adds the exception to every choice of its left side. None if an operator lacks an operand."""
    stack: list[list[frozenset[str]]] = []
    for tok in postfix:
        if tok in _PRECEDENCE:
            if len(stack) < 2:
                return None
            right, left = stack.pop(), stack.pop()
            if tok == "or":
                stack.append(sorted(set(left) | set(right), key=sorted))
            elif tok == "and":
                stack.append(sorted({a | b for a in left for b in right}, key=sorted))
            else:
                exceptions = frozenset(f"with:{x}" for choice in right for x in choice)
                stack.append([a | exceptions for a in left])
        else:
            stack.append([frozenset([tok])])
    return stack[0] if len(stack) == 1 else None


class Scanner:
    """Both automata, built once per Python worker."""

    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for kind, table in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES)):
            for phrase, label in table.items():
                self.phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> Found:
        """What the text holds. A null text is empty: no words, no places, labels '', score 0.

        Every place of a phrase counts, overlapping ones too; a notice phrase that holds a base phrase gives both.
        A tag whose expression is not well formed adds nothing.
        """
        lowered = (text or "").translate(_LOWER)
        words = WORD.findall(lowered)
        joined = " " + " ".join(words) + " "
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w) + 1
        base_places, base_labels, labels, weights = [], set(), set(), []
        if words:
            for end, (kind, label, size) in self.phrases.iter(joined):
                place = bisect_left(starts, end - size + 2)
                labels.add(label)
                weights.append(WEIGHTS[kind])
                if kind == "base":
                    base_places.append(place)
                    base_labels.add(label)
        expressions = []
        for end, _ in self.tags.iter(lowered):
            line_end = lowered.find("\n", end + 1)
            postfix = parse(lowered[end + 1: line_end if line_end >= 0 else len(lowered)])
            choices = evaluate(postfix) if postfix else None
            if not choices:
                continue
            weights.append(WEIGHTS["tag"])
            expressions.append(" | ".join(" & ".join(sorted(c)) for c in choices))
            labels.update(family(x) for c in choices for x in c if not x.startswith("with:"))
        missing = 1.0
        for w in weights:
            missing *= 1.0 - w
        return Found(
            len(words), len(base_places), min(base_places, default=None), max(base_places, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), 1.0 - missing, "; ".join(expressions))


_scanner: Scanner | None = None


def _shared() -> Scanner:
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def scan(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus the columns of ``RESULT`` for the text column (null: empty); columns of those names are replaced.

    Every row keeps its place, repeated rows and null ids included; long texts are read whole, in batches of bounded
    bytes; an empty table stays empty. The scan is narrow: no shuffle.
    """
    names = set(RESULT.names)
    kept = [c for c in rows.columns if c not in names]
    packed = rows.select(F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
                         rows[text].cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _shared()
        for batch in bounded(batches, "text"):
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([getattr(f, field.name) for f in found], _ARROW[field.name]) for field in RESULT.fields]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=schema.names)

    return packed.mapInArrow(run, schema).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *RESULT.names)


_ARROW = {f.name: {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}[type(f.dataType)]
          for f in RESULT.fields}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: licence places, labels and score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, "text").select("doc_id", *RESULT.names)
