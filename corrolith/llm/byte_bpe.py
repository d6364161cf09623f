"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays, without a regular expression: a table gives each code point its class (letter, number,
white space, other), look-ahead turns classes into symbols, and the tokenizer pattern becomes an automaton over these
symbols. A symbol is a function from states to states; functions compose associatively, so all states follow from a scan:
blocks of symbols are composed side by side, the block results are scanned, and the states inside all blocks are filled in
side by side. A start of a match is a property of state and symbol. The slices between starts are merged by rank, and
what a slice becomes is remembered in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import map_text

#: Slices up to so many bytes are remembered, and so many slices at most; neither changes an id.
KEPT_LENGTH, KEPT_SLICES = 64, 500_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Symbols: the four classes as they continue or start a run, and what look-ahead tells apart.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE2, S_QUOTE3, S_BLANK_BEFORE, S_SPACE_LAST, S_SPACE_INNER = range(8)
N_SYMBOLS = 8
#: States: the kind of match that the last code point belongs to. JOIN: a blank that the next match takes along.
#: DONE: a match that nothing continues. REST2, REST1: so many letters of a contraction are to come.
Q_START, Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE, Q_JOIN, Q_DONE, Q_REST2, Q_REST1 = range(9)
N_STATES = 9
#: Fixed value: the endings that the tokenizer pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether a match starts at this code point."""
    step, starts = np.zeros((N_SYMBOLS, N_STATES), np.uint8), np.zeros((N_SYMBOLS, N_STATES), bool)
    for q in range(N_STATES):
        for s in range(N_SYMBOLS):
            if q == Q_REST2:
                to, new = Q_REST1, False
            elif q == Q_REST1:
                to, new = Q_DONE, False
            elif s in (S_LETTER, S_NUMBER):
                to = Q_LETTER if s == S_LETTER else Q_NUMBER
                new = q not in (to, Q_JOIN)
            elif s == S_OTHER or s in (S_QUOTE2, S_QUOTE3) and q in (Q_OTHER, Q_JOIN):
                to, new = Q_OTHER, q not in (Q_OTHER, Q_JOIN)
            elif s in (S_QUOTE2, S_QUOTE3):
                to, new = (Q_REST1 if s == S_QUOTE2 else Q_REST2), True
            elif s == S_BLANK_BEFORE:  # the blank of " ?" in the pattern: last of its run, and a match follows
                to, new = Q_JOIN, True
            elif s == S_SPACE_LAST:  # other white space, last of its run, and a match follows: a match of its own
                to, new = Q_DONE, True
            else:
                to, new = Q_SPACE, q != Q_SPACE
            step[s, q], starts[s, q] = to, new
    return step, starts


STEP, STARTS = _automaton()
#: The same symbols at the first code point of a text: constant functions, which forget the text before.
STEP2 = np.concatenate([STEP, np.repeat(STEP[:, Q_START][:, None], N_STATES, 1)])
STARTS2 = np.concatenate([STARTS, np.ones_like(STARTS)])


def scan_states(symbols: np.ndarray, step: np.ndarray = STEP2, first: int = Q_START) -> np.ndarray:
    """The state before each symbol, by a blocked scan of composed transition functions."""
    n = len(symbols)
    if n <= BLOCK:
        states, q = np.empty(n, np.uint8), first
        for i, s in enumerate(symbols.tolist()):
            states[i] = q
            q = int(step[s, q])
        return states
    k = -(-n // BLOCK)
    padded = np.zeros(k * BLOCK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(k, BLOCK).T)
    width = step.shape[1]
    flat = np.ascontiguousarray(step).ravel()
    composed = np.tile(np.arange(width, dtype=np.intp)[:, None], (1, k))
    for column in columns:
        composed = flat[column.astype(np.intp) * width + composed].astype(np.intp)
    entry = _scan_functions(composed.T, first)
    states = np.empty((BLOCK, k), np.uint8)
    q = entry.astype(np.intp)
    for i, column in enumerate(columns):
        states[i] = q
        q = flat[column.astype(np.intp) * width + q].astype(np.intp)
    return np.ascontiguousarray(states.T).ravel()[:n]


def _scan_functions(functions: np.ndarray, first: int) -> np.ndarray:
    """The state before each of k functions (k x states), composing pairs until few are left."""
    k = len(functions)
    if k <= BLOCK:
        entry, q = np.empty(k, np.intp), first
        for i in range(k):
            entry[i] = q
            q = functions[i, q]
        return entry
    even, odd = functions[: k - k % 2 : 2], functions[1::2]
    pairs = np.take_along_axis(odd, even, 1)
    if k % 2:
        pairs = np.concatenate([pairs, functions[-1:]])
    above = _scan_functions(pairs, first)
    entry = np.empty(k, np.intp)
    entry[::2] = above
    entry[1::2] = functions[: k - k % 2 : 2][np.arange(k // 2), above[: k // 2]]
    return entry


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point, as the tiktoken library's own Unicode tables have it."""
    import tiktoken

    points = np.r_[0:0xD800, 0xE000:0x110000]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    found = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        got = bytes(probe.encode_ordinary(text)).decode()
        found[np.frombuffer(got.encode("utf-32-le"), "<u4")] = kind
    return found


def match_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether a match starts at each code point. heads: whether a text starts there."""
    n = len(points)
    kinds = class_table()[points]
    after = np.full(n, 255, np.uint8)  # the class of the next code point of the same text, 255 at its end
    after[:-1] = np.where(heads[1:], 255, kinds[1:])
    symbols = np.array([S_LETTER, S_NUMBER, S_SPACE_INNER, S_OTHER], np.uint8)[kinds]
    last = (kinds == SPACE) & (after != SPACE) & (after != 255)
    symbols[last] = S_SPACE_LAST
    symbols[last & (points == 32)] = S_BLANK_BEFORE
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        ends = np.append(np.flatnonzero(heads), n)
        room = ends[np.searchsorted(ends, quotes, "right")] - quotes - 1
        one = np.where(room >= 1, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(room >= 2, points[np.minimum(quotes + 2, n - 1)], 0)
        short, long = np.zeros(len(quotes), bool), np.zeros(len(quotes), bool)
        for ending in CONTRACTIONS:
            if len(ending) == 1:
                short |= one == ord(ending)
            else:
                long |= (one == ord(ending[0])) & (two == ord(ending[1]))
        symbols[quotes[long]] = S_QUOTE3
        symbols[quotes[short]] = S_QUOTE2
    symbols[heads] += N_SYMBOLS
    return STARTS2[symbols, scan_states(symbols)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank merges first, the leftmost of equals.

    A heap holds the pairs and a linked list the parts, so a slice of n bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or right[i] != j or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            k = right[i]
            r = ranks.get(piece[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if left[i] >= 0:
            k = left[i]
            r = ranks.get(piece[k : end[i]])
            if r is not None:
                heapq.heappush(heap, (r, k, i, end[i]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for piece, i in ranks.items():
            parts[i] = piece
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def piece(self, piece: str) -> bytes:
        """Ids of a slice as little-endian 32-bit integers."""
        data = piece.encode()
        ids = np.array(merge(data, self.ranks), "<u4").tobytes()
        if len(data) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_SLICES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = "".join(texts)
        if not whole:
            return [np.empty(0, "<u4") for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        heads = np.zeros(len(points), bool)
        heads[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(match_starts(points, heads))
        cuts = np.searchsorted(at, ends)
        bounds = np.append(at, len(points)).tolist()
        known, slow, out, done = self.known, self.piece, [], 0
        for cut in cuts.tolist():
            pieces = [whole[a:b] for a, b in zip(bounds[done:cut], bounds[done + 1 : cut + 1])]
            got = [known.get(p) or slow(p) for p in pieces]
            out.append(np.frombuffer(b"".join(got), "<u4"))
            done = cut
        return out

    def token_ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from one table by their offsets."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[index].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(read_ranks(path))


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per document: doc_id, ids array<int>, and with decode also decoded binary (from the ids).

    Null and empty texts have no ids and decode to nothing; repeated rows and null ids stay; whole texts are read, however
    long; an empty table gives none; other columns are not read, so they may have any names.
    ranks: path of a tiktoken rank file on every worker.
    """

    def make():
        t = tokenizer(ranks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = t.encode([x or "" for x in batch.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))]
            return pa.RecordBatch.from_arrays(columns + [pa.array([t.decode(x) for x in ids], pa.binary())] * decode, ["doc_id", "ids"] + ["decoded"] * decode)

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, "doc_id long, ids array<int>" + ", decoded binary" * decode, "text", make)


def encode_digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() with its ids and decoded bytes reduced to digests in the same pass.

    One row per document: doc_id, n_tokens long, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256, both lowercase hex. Null texts count as empty; the rest is as in encode_documents().
    """

    def make():
        t = tokenizer(ranks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = t.encode([x or "" for x in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text", make)
