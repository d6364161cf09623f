"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton reports every vocabulary piece that ends at a position, and dynamic programming over positions
carries only the best score and the number of pieces on the best path. Ties follow the unigram tokenizers: from left to
right a later start replaces an earlier one only if it scores strictly more, so of equal paths into a position the one with
the longest last piece stays. A character that is no piece by itself costs the lowest score less 10, and counts as its
UTF-8 bytes (byte fallback).

No piece has a space mark after another character, so the best path of a text is the best paths of its units, each a run of
space marks with what follows up to the next mark. Units repeat, and their counts are kept in a bounded table. Scores are
summed within a unit in 64-bit floats, exact for the whole-number scores of the vocabularies here.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import map_text

MARK = "▁"
#: Units up to this length are remembered, and so many of them at most; neither changes a count.
KEPT_LENGTH, KEPT_UNITS = 64, 1_000_000
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = 8 if wire == 1 else 4
            yield number, struct.unpack("<d" if wire == 1 else "<f", data[at : at + size])[0]
            at += size


def pieces_of(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the pieces of a SentencePiece model file that can be matched. User-defined and unused pieces count as
    ordinary ones with the score they have; control, byte and unknown pieces are none."""
    with open(path, "rb") as f:
        message = f.read()
    found = []
    for number, value in _fields(message):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) in (1, 4, 5):  # normal, user-defined, unused
                found.append((piece[1].decode(), float(piece.get(2, 0.0))))
    return found


class UnigramCounter:
    """Counts pieces on the best path of a text."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        if not pieces:
            raise ValueError("the vocabulary is empty")
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("pieces with an inner space mark are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.breaks = "\n" if not any("\n" in p for p, _ in pieces) else None
        self.known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Pieces of one unit by dynamic programming over its positions."""
        count = self.known.get(text)
        if count is not None:
            return count
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            ends[end].append(piece)
        score, number = [0.0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        for i in range(n):
            best, at, size = None, 0, 1
            for length, s in sorted(ends[i], reverse=True):  # earliest start first
                total = score[i + 1 - length] + s
                if best is None or total > best:
                    best, at = total, number[i + 1 - length]
            char = text[i]
            if char not in single:
                total = score[i] + unknown
                if best is None or total > best:
                    best, at, size = total, number[i], len(char.encode())
            score[i + 1], number[i + 1] = best, at + size
        if n <= KEPT_LENGTH:
            if len(self.known) >= KEPT_UNITS:
                self.known.clear()
            self.known[text] = number[n]
        return number[n]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text; a mark is put before it, spaces count as marks; null and empty texts have none."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        known, unit, total = self.known, self.unit, 0
        lines = text.split(self.breaks) if self.breaks else [text]
        total += len(lines) - 1  # a break is a character outside every piece: one byte
        for k, line in enumerate(lines):
            if k == 0:
                line = " " + line
            if not line:
                continue
            if "  " in line or line.endswith(" "):
                units = [u.replace(" ", MARK) for u in re.findall(" *[^ ]+| +", line)]
            else:
                first, *rest = line.split(" ")
                units = [MARK + w for w in rest]
                if first:
                    units.append(first)
            for u in units:
                c = known.get(u)
                total += unit(u) if c is None else c
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(pieces_of(path))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens long, n_chars long (code points).

    Null and empty texts have 0 of both; repeated rows and null ids stay as they are; whole texts are read, however long; an
    empty table gives none; other columns are not read, so they may have any names.
    model: path of a SentencePiece model file on every worker; its pieces and scores are used as a unigram vocabulary.
    """

    def make():
        c = counter(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, "doc_id long, n_tokens long, n_chars long", "text", make)
