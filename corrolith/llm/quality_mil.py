"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by one layer from shares of character and word shapes
and from the mean of learned vectors of its words (hashed to a table of fixed size, case ignored), and is given a weight by
gated attention; the score comes from the weighted passage representation. Word vectors, encoder, attention and classifier
are learned together from document labels, in mini-batches of whole documents. Training reads a bounded sample of labelled
documents on the driver; scoring reads every passage of every document in numpy batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import map_text, release, word_hashes, words_of, written

WORDS = 64
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _COMMA, _MARK, _BAR, _SYMBOL, _OTHER, _HIGH = range(11)
N_CLASSES = 11
N_FEATURES = N_CLASSES + 10
#: Rows of the table of word vectors, and words whose vectors are gathered at once.
BUCKETS, GATHERED = 1024, 1 << 17


def _byte_classes() -> np.ndarray:
    c = np.full(256, _OTHER, np.uint8)
    c[[32, 9, 10, 11, 12, 13]] = _SPACE
    c[97:123], c[65:91], c[48:58], c[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
    for chars, k in ((".", _STOP), (",", _COMMA), ("!?", _MARK), ("|", _BAR), ("*#$%&@~^_=<>/\\{}[]+", _SYMBOL)):
        c[[ord(x) for x in chars]] = k
    return c


CLASSES = _byte_classes()


@dataclass
class Bags:
    """Passages of some texts. x: shape features by passage. n: passages of each text. words: buckets of all words, passage by
    passage. size: words of each passage, 0 for the one passage of a text without words."""

    x: np.ndarray
    n: np.ndarray
    words: np.ndarray
    size: np.ndarray


def passages(texts: list[str | None]) -> Bags:
    """The passages of whole texts. What a passage is described by depends on its own text alone."""
    body, start, end, first = words_of(texts)
    kind = CLASSES[body]
    words = np.diff(first)
    n = np.maximum(1, -(-words // WORDS))
    owner = np.repeat(np.arange(len(texts)), n)
    x = np.zeros((int(n.sum()), N_FEATURES), np.float32)
    size = np.zeros(len(x), np.int64)
    x[:, N_CLASSES + 9] = np.log1p(words[owner]) / 10
    if not len(start):
        return Bags(x, n, np.empty(0, np.uint16), size)
    hashed = word_hashes(body, start, end, lower=True)
    length = end - start
    number = np.arange(len(start)) - np.repeat(first[:-1], words)
    opens = np.flatnonzero(number % WORDS == 0)  # first word of each passage that has words
    has = np.flatnonzero(words[owner] > 0)
    size[has] = np.diff(np.append(opens, len(start)))
    count = size[has].astype(np.float32)
    at, last = start[opens], end[np.append(opens[1:], len(start)) - 1]
    f = np.zeros((len(at), N_FEATURES), np.float32)
    ink = np.zeros(len(at), np.int64)
    for k in range(N_CLASSES):
        if k != _SPACE:
            sums = np.concatenate([[0], np.cumsum(kind == k)])
            f[:, k] = sums[last] - sums[at]
            ink += sums[last] - sums[at]
    f[:, _SPACE] = (last - at) - ink
    f[:, :N_CLASSES] /= np.maximum(1, ink)[:, None]
    share = lambda mask: np.add.reduceat(mask.astype(np.int32), opens) / count
    again = np.concatenate([[False], hashed[1:] == hashed[:-1]])
    again[opens] = False
    f[:, N_CLASSES] = np.add.reduceat(length, opens) / count / 10
    f[:, N_CLASSES + 1] = share(length <= 2)
    f[:, N_CLASSES + 2] = share(length >= 12)
    f[:, N_CLASSES + 3] = share(again)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (hashed >> np.uint64(58)), opens)
    f[:, N_CLASSES + 4] = np.bitwise_count(bits) / np.minimum(count, 64)
    head, tail = kind[start], kind[end - 1]
    f[:, N_CLASSES + 5] = share(head == _UPPER)
    f[:, N_CLASSES + 6] = share((tail == _UPPER) & (length > 1))
    f[:, N_CLASSES + 7] = share((tail == _STOP) | (tail == _COMMA))
    f[:, N_CLASSES + 8] = share((tail != _LOWER) & (tail != _HIGH) & (tail != _STOP) & (tail != _COMMA) & (tail != _UPPER))
    f[:, N_CLASSES + 9] = x[has, N_CLASSES + 9]
    x[has] = f
    return Bags(x, n, (hashed % np.uint64(BUCKETS)).astype(np.uint16), size)


@dataclass(frozen=True)
class Training:
    """sample: most labelled documents used, and passages: most passages of them together; documents are taken whole, in the
    order of a hash of their ids, while both hold. These bound the driver's memory. batch: documents of a step. units:
    width of encoder, word vectors and attention."""

    sample: int = 3000
    passages: int = 200_000
    units: int = 16
    batch: int = 64
    steps: int = 500
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 7


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, bags: Bags) -> np.ndarray:
        """Scores of texts, to six digits, so that the shape of a batch can't show in them."""
        x = (bags.x - self.mean.astype(np.float32)) / self.scale.astype(np.float32)
        return np.round(_forward(self.p, x, bags)[0].astype(np.float64), 6)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def word_means(vectors: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean vector of the words of each passage, 0 without words; gathered in bounded pieces."""
    out = np.zeros((len(size), vectors.shape[1]), vectors.dtype)
    has = np.flatnonzero(size)
    at = _starts(size)[has]
    step = max(1, GATHERED // WORDS)
    for i in range(0, len(has), step):
        some = has[i : i + step]
        first, stop = at[i], at[i + len(some) - 1] + size[some[-1]]
        out[some] = np.add.reduceat(vectors[words[first:stop]], at[i : i + len(some)] - first, axis=0) / size[some][:, None].astype(vectors.dtype)
    return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bags: Bags):
    h = np.tanh(x @ p["W"] + word_means(p["E"], bags.words, bags.size) + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    a = (t * g) @ p["w"]
    at, n = _starts(bags.n), bags.n
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
    a = a / np.repeat(np.add.reduceat(a, at), n)
    z = np.add.reduceat(a[:, None] * h, at)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return y, z, a, h, t, g, at


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, bags: Bags, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of document labels and its gradient."""
    y, z, a, h, t, g, at = _forward(p, x, bags)
    n = bags.n
    dy = (y - label) / len(label)
    dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
    da = (dz * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
    dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    each = np.repeat(dh / np.maximum(1, bags.size)[:, None].astype(dh.dtype), bags.size, axis=0)  # of each word
    order = np.argsort(bags.words, kind="stable")
    sums = np.zeros_like(p["E"])
    if len(order):
        sorted_words = bags.words[order]
        opens = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]))
        sums[sorted_words[opens]] = np.add.reduceat(each[order], opens, axis=0)
    grad = {"W": x.T @ dh, "E": sums, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ dy, "d": dy.sum()}
    safe = np.clip(y, 1e-12, 1 - 1e-12)
    return float(-(label * np.log(safe) + (1 - label) * np.log(1 - safe)).mean()), grad


def start_weights(units: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    u = units
    return {"W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, u)), "E": rng.normal(0, 0.1, (BUCKETS, u)), "b": np.zeros(u), "V": rng.normal(0, u**-0.5, (u, u)), "U": rng.normal(0, u**-0.5, (u, u)), "w": np.zeros(u), "c": rng.normal(0, u**-0.5, u), "d": np.zeros(())}


def pick(bags: Bags, texts: np.ndarray) -> Bags:
    """The passages of some texts, in the given order."""
    first, word = _starts(bags.n), _starts(bags.size)
    rows = np.concatenate([np.arange(first[i], first[i] + bags.n[i]) for i in texts])
    words = np.concatenate([bags.words[word[r] : word[r] + bags.size[r]] for r in rows])
    return Bags(bags.x[rows], bags.n[texts], words, bags.size[rows])


def train(bags: Bags, label: np.ndarray, how: Training = Training()) -> Model:
    """Adam on the cross entropy, over mini-batches of documents. Without labels, or with one class only, the model gives
    every document that class's share, smoothed."""
    p = start_weights(how.units, how.seed)
    mean, scale = (bags.x.mean(0), bags.x.std(0) + 1e-3) if len(bags.x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if len(set(label.tolist())) < 2:
        p["c"] = np.zeros(how.units)
        share = (label.sum() + 0.5) / (len(label) + 1)
        p["d"] = np.array(np.log(share / (1 - share)))
        return Model(mean, scale, p)
    p = {k: q.astype(np.float32) for k, q in p.items()}
    label = label.astype(np.float32)
    p["d"] = np.array(np.log(label.mean() / (1 - label.mean())), np.float32)
    mixed = np.random.default_rng(how.seed).permutation(len(label))
    batches = []
    for i in range(0, len(mixed), how.batch):
        some = mixed[i : i + how.batch]
        b = pick(bags, some)
        batches.append((((b.x - mean) / scale).astype(np.float32), b, label[some]))
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    for step in range(1, how.steps + 1):
        _, grad = loss_and_gradient(p, *batches[step % len(batches)])
        rate = how.rate * (1 - (step - 1) / how.steps)
        for k in p:
            g = grad[k] + how.decay * p[k] * (k in "WVUcE")
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labels (0 or 1; others and nulls are ignored; of several labels of a document the lowest counts) of a
    sample of documents, see Training. All passages of a sampled document are read. Rows that share an id are examples
    each; labels without a document and null ids are ignored; without examples the model gives 0.5."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("double").alias("__label"))
    chosen = marks.orderBy(F.xxhash64("__id"), "__id").limit(how.sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id").select("__id", "text", "__label")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            b = passages(batch.column(1).to_pylist())
            at, word = np.append(0, np.cumsum(b.n)), np.append(0, np.cumsum(b.size))
            parts = [[b.x[i:j].astype("<f4").tobytes() for i, j in zip(at, at[1:])], [b.size[i:j].astype("<u1").tobytes() for i, j in zip(at, at[1:])], [b.words[word[i] : word[j]].astype("<u2").tobytes() for i, j in zip(at, at[1:])]]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(b.n, pa.int64()), *[pa.array(x, pa.binary()) for x in parts]], ["id", "label", "n", "x", "size", "words"])

        return each

    found = written(map_text(rows, "id long, label double, n long, x binary, size binary, words binary", "text", make), "quality-bags")
    order = [F.xxhash64("id"), F.col("id"), F.md5("x"), F.md5("words")]
    sizes = [r[0] for r in found.orderBy(*order).select("n").limit(how.sample).collect()]
    fits = int((np.cumsum(np.array(sizes, np.int64)) <= how.passages).sum())
    taken = found.orderBy(*order).limit(fits).collect() if fits else []
    release(found)
    if not taken:
        return train(Bags(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.empty(0, np.uint16), np.zeros(0, np.int64)), np.zeros(0), how)
    x = np.frombuffer(b"".join(r.x for r in taken), "<f4").reshape(-1, N_FEATURES)
    bags = Bags(x, np.array([r.n for r in taken]), np.frombuffer(b"".join(r.words for r in taken), "<u2"), np.frombuffer(b"".join(r["size"] for r in taken), "<u1").astype(np.int64))
    return train(bags, np.array([r.label for r in taken]), how)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Scores every whole text, however long: doc_id, score (0 to 1), and with carry the whole input row as the struct __row.

    Null and empty texts get the score of a text without words; repeated rows and null ids stay; an empty table gives none.
    A score depends on the text alone. Other columns may have any names.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(passages(batch.column(1).to_pylist()))), *batch.columns[2:]], ["doc_id", "score"] + ["__row"] * carry)

        return each

    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")] * carry
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *row)
    kind = f", __row {rows.schema['__row'].dataType.simpleString()}" if carry else ""
    return map_text(rows, f"doc_id long, score double{kind}", "__text", make)


def good_rows(docs: DataFrame, model: Model, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns, whatever their names. Null texts are scored as
    empty; an empty table stays empty."""
    return score_documents(docs, model, id_col, text_col, carry=True).filter(F.col("score") >= least).select("__row.*")


def held_out(id_col: str):
    """Rows whose crc32 of the id as text leaves remainder 2 by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
