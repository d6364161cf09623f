"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field labels the words of a line
with what they belong to, from the shapes of the word and of two neighbours on either side, and finds what the patterns
miss: two cards side by side, phone numbers without a plus sign, spelled-out e-mail addresses. It is trained on a small
labelled table, made from a rule, and decoded by Viterbi over many lines at once. Lines whose words all have the plain
shape are not decoded: the trained weights are checked to leave them unlabelled, whatever their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import map_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches in order. Each kind is scanned in linear time."""
    found = []
    if "@" in text:
        at, low = text.find("@"), 0
        while at >= 0:  # the sign is in no local part, so the parts looked through never overlap
            start = low + len(text[low:at].rstrip(_LOCAL))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                found.append((start, 0, m.end()))
            low = m.end() if m else at + 1
            at = text.find("@", low)
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            if m[0].count(".") >= 3:
                parts, at = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    size = sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                        found.append((at, 1, at + size))
                    at += size + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _only_digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the field ----

LABELS = ("O", "B0", "I0", "B1", "I1", "B2", "I2", "B3", "I3")
K = len(LABELS)
SHAPES = ("pad", "plain", "mail", "quad", "card", "long", "four", "plus", "area", "short-dash", "long-dash", "number", "small", "dotted", "mixed", "at", "dot", "full-plus", "open", "sign")
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
PLAIN = _SHAPE["plain"]
WIDTH = 5  # the word and two neighbours on either side
_AT, _DOT = re.compile(r"[(\[{<]at[)\]}>]", re.I), re.compile(r"[(\[{<]dot[)\]}>]", re.I)
_EDGE = "\"'.,;:!?*#$%&|<>[]{}_~^=/\\"
_HOLDS = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> int:
    """The shape of a word."""
    if not _HOLDS.search(word):
        return PLAIN
    if _AT.fullmatch(word):
        return _SHAPE["at"]
    if _DOT.fullmatch(word):
        return _SHAPE["dot"]
    w = word.strip(_EDGE)
    d = _only_digits(w)
    if "@" in w:
        return _SHAPE["mail" if re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", w) else "sign"]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", w):
        return _SHAPE["quad" if all(int(p[-4:]) <= 255 and len(p) <= 3 for p in w.split(".")) else "dotted"]
    if re.fullmatch(r"[0-9]+", w):
        if 14 <= len(w) <= 19:
            return _SHAPE["card" if luhn(w) else "long"]
        return _SHAPE["long" if len(w) > 19 else "four" if len(w) == 4 else "small" if len(w) < 4 else "number"]
    if re.fullmatch(r"\+[0-9]{1,3}", w):
        return _SHAPE["plus"]
    if re.fullmatch(r"\+[0-9().-]+", w):
        return _SHAPE["full-plus" if 10 <= len(d) <= 15 else "mixed"]
    if re.fullmatch(r"\([0-9]{2,4}\)", w):
        return _SHAPE["area"]
    if re.fullmatch(r"[0-9]{3}-[0-9]{4}", w):
        return _SHAPE["short-dash"]
    if re.fullmatch(r"\(?[0-9]{3}\)?-[0-9]{3}-[0-9]{4}", w):
        return _SHAPE["long-dash"]
    if re.fullmatch(r"[0-9]+([.,][0-9]+)+", w):
        return _SHAPE["dotted"]
    return _SHAPE["mixed" if d else "open"]


def labelled_table(lines: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: lines of invented words with personal data, and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ra", "lo", "ti", "men", "su", "ko", "an", "de", "vir"]) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def valid(n: int) -> str:
        d = digits(n - 1)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def phone() -> list[str]:
        return r.choice([[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"({digits(3)})-{digits(3)}-{digits(4)}"], [f"+{digits(11)}"]])

    def invalid() -> str:
        d = valid(16)
        return d[:-1] + str((int(d[-1]) + 3) % 10)

    data = {
        0: lambda: r.choice([[f"{word()}.{digits(2)}@{word()}.com"], [word(), "(at)", word(), "(dot)", "com"], [word(), "[at]", word(), "[dot]", "org"], [f"{word()}@{word()}.{word()}.net"]]),
        1: lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))],
        2: lambda: [valid(r.choice([14, 15, 16, 16, 16, 19]))],
        3: phone,
    }
    nothing = [lambda: [f"{r.randint(0, 9)}.0."], lambda: [digits(4)], lambda: [digits(r.randint(1, 3))], lambda: [digits(r.randint(5, 12))], lambda: [f'"{hashlib.md5(word().encode()).hexdigest()}"'], lambda: [f"{digits(4)}-{digits(2)}-{digits(2)}"], lambda: [f"{digits(3)}-{digits(4)}"], lambda: [f"({digits(3)})"], lambda: [f"+{digits(1)}"], lambda: [f"{digits(2)}.{digits(2)}"], lambda: [invalid()], lambda: [".".join(digits(3) for _ in range(5))], lambda: ["(at)"], lambda: ["@" + word()], lambda: [digits(4), digits(4), digits(4)], lambda: [digits(24)]]
    table = []
    for _ in range(lines):
        words, marks = [], []
        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(0, 4)):
                words.append(word() + r.choice(["", "", "", ".", ","]))
                marks.append("O")
            if r.random() < 0.5:
                for _ in range(r.choice([1, 1, 1, 2])):
                    k = r.randrange(4)
                    got = data[k]()
                    got[-1] += r.choice(["", "", "", ",", ".", "!!", "***"])
                    words += got
                    marks += [f"B{k}"] + [f"I{k}"] * (len(got) - 1)
            elif r.random() < 0.6:
                got = r.choice(nothing)()
                words += got
                marks += ["O"] * len(got)
            else:
                words.append(word())
                marks.append("O")
        table.append((words, marks))
    return table


def windows(shapes: np.ndarray) -> np.ndarray:
    """shapes (lines x words, pad outside) with two neighbours on either side: lines x words x WIDTH."""
    padded = np.pad(shapes, ((0, 0), (2, 2)))
    return np.stack([padded[:, i : i + shapes.shape[1]] for i in range(WIDTH)], 2)


class Field:
    """weights[place, shape, label], moves[label, label], first[label]."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        w = windows(shapes)
        return sum(self.weights[i][w[:, :, i]] for i in range(WIDTH))

    def decode(self, lines: list[list[int]]) -> list[np.ndarray]:
        """Best labels of each line of shapes; lines of like length are decoded together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(lines)
        order = sorted((i for i in range(len(lines)) if lines[i]), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            longest, stop = 0, at
            while stop < len(order) and (stop == at or len(lines[order[stop]]) * (stop + 1 - at) <= max(200_000, longest)):
                longest = len(lines[order[stop]])
                stop += 1
            some = order[at:stop]
            for i, best in zip(some, self._viterbi([lines[i] for i in some])):
                out[i] = best
            at = stop
        return out

    def _viterbi(self, lines: list[list[int]]) -> list[np.ndarray]:
        size = np.array([len(x) for x in lines])
        shapes = np.zeros((len(lines), size.max()), np.int64)
        for i, x in enumerate(lines):
            shapes[i, : len(x)] = x
        e = self.scores(shapes)
        back = np.zeros((shapes.shape[1], len(lines), K), np.int8)
        best = self.first + e[:, 0]
        for t in range(1, shapes.shape[1]):
            step = best[:, :, None] + self.moves
            back[t] = step.argmax(1)
            new = step.max(1) + e[:, t]
            best = np.where((t < size)[:, None], new, best)
            back[t][t >= size] = np.arange(K)
        label = best.argmax(1)
        path = np.zeros(shapes.shape, np.int64)
        rows = np.arange(len(lines))
        for t in range(shapes.shape[1] - 1, -1, -1):
            path[:, t] = label
            if t:
                label = back[t][rows, label]
        return [path[i, :n] for i, n in enumerate(size)]

    def plain_is_unlabelled(self) -> bool:
        """Whether a line of plain words never gets a label: any labelled stretch of m words loses m times the least gap
        between plain and labelled scores and wins at most m + 1 moves."""
        gap = np.inf
        for left in range(3):
            for right in range(3):
                w = [0] * (2 - left) + [PLAIN] * (left + 1 + right) + [0] * (2 - right)
                e = sum(self.weights[i][w[i]] for i in range(WIDTH))
                gap = min(gap, e[0] - e[1:].max())
        gain = max(0.0, float(self.moves.max() - self.moves[0, 0]), float(self.first.max() - self.first[0]))
        return bool(gap >= 2 * gain)


def train(table: list[tuple[list[str], list[str]]], steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward sums and Adam, over all lines at once."""
    n = max(len(w) for w, _ in table)
    shapes, gold = np.zeros((len(table), n), np.int64), np.zeros((len(table), n), np.int64)
    for i, (words, marks) in enumerate(table):
        shapes[i, : len(words)] = [shape(w) for w in words]
        gold[i, : len(words)] = [LABELS.index(m) for m in marks]
    size = np.array([len(w) for w, _ in table])
    live = np.arange(n) < size[:, None]
    w = windows(shapes)
    p = {"weights": np.zeros((WIDTH, len(SHAPES), K)), "moves": np.zeros((K, K)), "first": np.zeros(K)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    one = np.eye(K)[gold] * live[:, :, None]
    both = live[:, 1:] & live[:, :-1]
    rows = np.arange(len(table))
    for step in range(1, steps + 1):
        e = sum(p["weights"][i][w[:, :, i]] for i in range(WIDTH))
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        a[:, 0] = p["first"] + e[:, 0]
        for t in range(1, n):
            s = a[:, t - 1, :, None] + p["moves"]
            top = s.max(1)
            a[:, t] = np.where(live[:, t, None], top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:, t], a[:, t - 1])
        for t in range(n - 2, -1, -1):
            s = p["moves"] + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            top = s.max(2)
            b[:, t] = np.where(live[:, t + 1, None], top + np.log(np.exp(s - top[:, :, None]).sum(2)), 0)
        last = a[rows, size - 1]
        z = last.max(1) + np.log(np.exp(last - last.max(1)[:, None]).sum(1))
        marginal = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        pair = np.exp(a[:, :-1, :, None] + p["moves"] + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        diff = marginal - one
        grad = {"weights": np.zeros_like(p["weights"]), "first": diff[:, 0].sum(0), "moves": pair.sum((0, 1)) - np.einsum("lti,ltj->ij", one[:, :-1] * both[:, :, None], one[:, 1:])}
        for i in range(WIDTH):
            np.add.at(grad["weights"][i], w[:, :, i][live], diff[live])
        for k in p:
            g = grad[k] / len(table) + decay * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Field(p["weights"], p["moves"], p["first"])


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def _trimmed(text: str, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """The labelled stretch without the punctuation around it, or None if it can't be of this kind."""
    s = text[start:end]
    front = len(s) - len(s.lstrip(_EDGE + ("" if kind == 3 else "(")))
    s2 = s[front:].rstrip(_EDGE + ")-")
    start, end = start + front, start + front + len(s2)
    d = _only_digits(s2)
    ok = (
        re.search(r"@|[(\[{<]at[)\]}>]", s2, re.I) is not None
        if kind == 0
        else re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s2) is not None
        if kind == 1
        else 14 <= len(d) <= 19 and luhn(d)
        if kind == 2
        else 7 <= len(d) <= 15
    )
    return (start, end) if ok and end > start else None


def all_spans(texts: list[str], field: Field, skip_plain: bool) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as (start, kind, end) in order. A span of the field that overlaps a base
    span of any kind is left out."""
    base = [base_spans(t) for t in texts]
    lines, places = [], []
    for i, text in enumerate(texts):
        if skip_plain and not _HOLDS.search(text):
            continue
        at = 0
        for line in text.split("\n"):
            if line and (not skip_plain or _HOLDS.search(line)):
                found = [(m.start() + at, m.end() + at) for m in _WORD.finditer(line)]
                if found:
                    lines.append([shape(text[a:b]) for a, b in found])
                    places.append((i, found))
            at += len(line) + 1
    extra: dict[int, list] = {}
    for (i, found), labels in zip(places, field.decode(lines)):
        if not labels.any():
            continue
        marks, j = labels.tolist(), 0
        while j < len(marks):
            kind = (marks[j] - 1) // 2
            if marks[j] == 0:
                j += 1
                continue
            stop = j + 1
            while stop < len(marks) and marks[stop] == 2 * kind + 2:
                stop += 1
            span = _trimmed(texts[i], found[j][0], found[stop - 1][1], kind)
            if span:
                extra.setdefault(i, []).append((span[0], kind, span[1]))
            j = stop
    out = []
    for i, b in enumerate(base):
        more = [x for x in extra.get(i, ()) if all(x[2] <= y[0] or y[2] <= x[0] for y in b)] if i in extra else []
        out.append((b, sorted(b + more) if more else b))
    return out


def written_spans(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (long; base spans), base_sha256, spans (base and added).

    Spans are kind:start:end in code points, end exclusive, ordered by start and kind and joined by commas. Null and empty
    texts have no span; repeated rows and null ids stay; whole texts are read, however long; an empty table gives none; other
    columns are not read, so they may have any names.
    """
    field = default_field()
    skip = field.plain_is_unlabelled()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], field, skip)
            counts = [pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(written_spans(b).encode()).hexdigest() for b, _ in found]
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array([written_spans(s) for _, s in found])], names)

        return each

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", "text", make)
