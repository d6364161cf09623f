"""Near duplicates: an exact Jaccard join over word shingles by a grouped prefix join.

1. Signatures. Every document becomes its set of distinct shingles (as 64-bit hashes) and the set's digest; equal sets are
   one node from here on. The same pass counts shingles in a sketch of fixed size, which only serves to put rare ones first.
2. Prefixes. In that order two sets that link share a shingle among their first few. Sets with identical prefix and size are
   one group; a group posts each shingle of its prefix once. Lists of frequent shingles are dealt out over several tasks.
3. Group pairs. A short list gives the pairs of its groups that can link, by their sizes and the places of the shingle, at
   most SHORT - 1 for each entry. A long list is kept as a list.
4. Verification. Groups are expanded to their sets, and the texts of the sets that are left meet in pairs. In a long list
   each set is first compared with a leader; sets that meet in one component need no further comparison. At last all
   pairs of a list that are in different components, can link and have not been compared are compared. So no link between
   components is lost, and a group of copies costs a number of comparisons in proportion to its size.
5. Components: forests inside tasks, then relinking and pointer jumping over what they leave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import fresh, mixed, partitions, release, small_batches, with_place, word_hashes, words_of, written

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch, and rows that carry it.
SLOTS, BLOCKS = 1 << 20, 64
#: Postings of a shingle that go to one task.
LIST_SLICE = 4000
#: Postings of a part, the unit that a task holds in memory, and postings that a task gathers before it deals them out.
PART, GATHERED = 1_000_000, 500_000
#: Longest list whose group pairs are all formed (of those that can link), and most sets of a group that is expanded in pairs.
SHORT, CROWD = 64, 8
#: Rounds of comparison with leaders before the rest is compared pair by pair.
ROUNDS = 6
#: Edges that a task's forest holds at once.
FOREST = 500_000
_POSTING = np.dtype([("t", "<i8"), ("g", "<i8"), ("n", "<u4"), ("pos", "<u4")])
_MEMBER = np.dtype([("g", "<i8"), ("a", "<u8"), ("b", "<u8"), ("n", "<u4")])
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text: A-Z lower-cased, words between white space, runs of `size`
    words, or all words as one where they are fewer; none without words."""
    body, start, end, first = words_of(texts)
    words = word_hashes(body, start, end, lower=True)
    with np.errstate(over="ignore"):
        place = np.resize(_PLACE, size) + np.arange(size, dtype=np.uint64) * np.uint64(2)
        runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            runs += words[j : j + len(runs)] * place[j]
        runs = mixed(runs)
        out = []
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                out.append(mixed((words[a:b] * place[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def largest_partner(n, pos):
    """The largest size of a set that can link to a set of n whose shared shingle with the least place is at place pos:
    the overlap, at least PERCENT / (100 + PERCENT) of both sizes, must fit into what follows."""
    return (n - pos) * (100 + PERCENT) // PERCENT - n


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """docs: key, text. kind 0: key, n, s (digest of the set, null if empty). kind 1: a block of the sketch."""
    names = ["kind", "key", "n", "s", "block", "counts"]
    key_type = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(SLOTS, np.uint32), None
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column(1).to_pylist())
            kind = batch.column(0).type
            if sets:
                np.add(counts, np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS), out=counts, casting="unsafe")
            k = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            blocks = counts.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(BLOCKS, np.int32)), pa.nulls(BLOCKS, kind), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([b.astype("<u4").tobytes() for b in blocks], pa.binary())], names)

    return docs.mapInArrow(run, f"kind int, key {key_type.simpleString()}, n long, s binary, block int, counts binary")


def _sketch(signatures: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches, of fixed size."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // BLOCKS, np.uint64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(c, "<u4")
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    rows = signatures.filter("kind = 1").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), np.uint32)
    for block, counts in rows:
        out[block] = np.frombuffer(counts, "<u4")
    return out.ravel()


def _slices(count: np.ndarray, noise: int) -> np.ndarray:
    """Tasks over which a shingle's postings are dealt."""
    return 1 + np.maximum(0, count.astype(np.int64) - noise) // LIST_SLICE


def _postings(docs: DataFrame, sketch, noise: int, parts: int) -> DataFrame:
    """Blobs of postings (kind 0) and of group members (kind 1) by part."""

    def dealt(post: list[tuple[np.ndarray, int, int]], members: list[tuple], counts: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        if post:
            size = [len(t) for t, _, _ in post]
            rows = np.empty(sum(size), _POSTING)
            rows["t"] = np.concatenate([t for t, _, _ in post])
            rows["g"], rows["n"] = np.repeat([g for _, g, _ in post], size), np.repeat([n for _, _, n in post], size)
            rows["pos"] = np.concatenate([np.arange(k) for k in size])
            t = rows["t"].view(np.uint64)
            many = _slices(counts[_slot(t)], noise)
            with np.errstate(over="ignore"):
                salt = mixed(rows["g"].view(np.uint64) + np.uint64(1)) % many.astype(np.uint64)
                part = (mixed(t + salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) % np.uint64(parts)
            out += _cut(0, part.astype(np.int64), rows)
        member = np.array(members, _MEMBER)
        out += _cut(1, ((mixed(member["a"]) >> np.uint64(11)) % np.uint64(parts)).astype(np.int64), member)
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["kind", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        known, posted, post, members, gathered = set(), set(), [], [], 0
        for batch in small_batches(batches, "text"):
            for s in shingle_sets(batch.column(1).to_pylist()):
                n = len(s)
                if not n:
                    continue
                d = _digest(s)
                if d in known:
                    continue
                known.add(d)
                p = prefix_length(n)
                count = counts[_slot(s)]
                order = np.argsort(count, kind="stable")[:p]  # s is sorted: ties by hash
                front = s[order].view(np.int64)
                name = hashlib.blake2b(front.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest()
                g = int.from_bytes(name, "little", signed=True)
                members.append((g, *np.frombuffer(d, "<u8").tolist(), n))
                if name not in posted:
                    posted.add(name)
                    post.append((front, g, n))
                    gathered += p
            if gathered >= GATHERED or len(members) >= GATHERED:
                yield dealt(post, members, counts)
                post, members, gathered = [], [], 0
                if len(known) > 200_000:  # only spares repeats
                    known, posted = set(), set()
        if members:
            yield dealt(post, members, counts)

    return docs.select("key", "text").mapInArrow(run, "kind int, part long, blob binary")


def _cut(kind: int, part: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """rows by part, each as its fields one after the other."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(kind, int(part[a]), b"".join(np.ascontiguousarray(rows[a:b][f]).tobytes() for f in rows.dtype.names)) for a, b in zip(at, np.append(at[1:], len(part)))]


def _joined(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of blobs of _cut()."""
    sizes = [len(b) // kind.itemsize for b in blobs]
    out = np.empty(sum(sizes), kind)
    at = 0
    for b, k in zip(blobs, sizes):
        skip = 0
        for f in kind.names:
            out[f][at : at + k] = np.frombuffer(b, kind[f], k, skip)
            skip += k * kind[f].itemsize
        at += k
    return out


def group_pairs(post: np.ndarray, most: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings ordered by t, n: the pairs of groups (g, h) of short lists that can link, and which rows lie in long
    lists. cut: rows of lists of which other tasks hold parts; they count as long."""
    k = len(post)
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(0, bool)
    t, g = post["t"], post["g"]
    n = post["n"].astype(np.int64)
    hi = largest_partner(n, post["pos"].astype(np.int64))
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(at, k))
    long = (np.repeat(size, size) > most) | cut
    left, right = [], []
    rows = np.flatnonzero(~long & (np.repeat(size, size) > 1))
    rest = (np.repeat(at + size, size) - np.arange(k))[rows]  # rows of the list from here on
    for d in range(1, most):
        rows, rest = rows[rest > d], rest[rest > d]
        if not len(rows):
            break
        i, j = rows, rows + d
        ok = (n[j] <= hi[i]) & (n[i] <= hi[j]) & (100 * n[i] >= PERCENT * n[j]) & (g[i] != g[j])
        left.append(np.minimum(g[i[ok]], g[j[ok]]))
        right.append(np.maximum(g[i[ok]], g[j[ok]]))
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1], long


def _lists(postings: DataFrame, sketch, noise: int) -> DataFrame:
    """kind 0: pairs of groups (g, h). kind 1: t, g, n, pos of long lists. kind 2: g, s, n, each set once for each part."""

    def run(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        post = _joined([b for k, b in zip(kinds, blobs) if k == 0], _POSTING)
        member = np.unique(_joined([b for k, b in zip(kinds, blobs) if k == 1], _MEMBER))
        if len(post):
            post = post[np.lexsort((post["g"], post["n"], post["t"]))]
            post = post[np.concatenate([[True], (post["t"][1:] != post["t"][:-1]) | (post["g"][1:] != post["g"][:-1])])]
        g, h, long = group_pairs(post, SHORT, _slices(sketch.value[_slot(post["t"].view(np.uint64))], noise) > 1)
        post = post[long]
        p, k, m = len(g), len(post), len(member)
        s = [x.tobytes() for x in np.ascontiguousarray(np.stack([member["a"], member["b"]], 1))] if m else []
        zeros = lambda i: np.zeros(i, np.int64)
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1, 2], np.int32), [p, k, m])),
                "t": pa.array(np.concatenate([h, post["t"], zeros(m)])),
                "g": pa.array(np.concatenate([g, post["g"], member["g"]])),
                "n": pa.array(np.concatenate([zeros(p), post["n"].astype(np.int64), member["n"].astype(np.int64)])),
                "pos": pa.array(np.concatenate([zeros(p), post["pos"].astype(np.int64), zeros(m)])),
                "s": pa.array([None] * (p + k) + s, pa.binary()),
            }
        )

    return postings.groupBy("part").applyInArrow(run, "kind int, t long, g long, n long, pos long, s binary")


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes in column h, packed, of at most 8 MB: which documents are worth shingling again."""
    count = nodes.count()
    bits = 1 << min(26, max(16, (16 * count).bit_length()))
    pieces = 32

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits // 8, np.uint8)
        some = False
        for batch in batches:
            for at in _bits(np.asarray(batch.column(0), dtype=np.int64), bits):
                np.bitwise_or.at(mask, at >> 3, (1 << (at & 7)).astype(np.uint8))
                some = some or len(at) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array([p.tobytes() for p in mask.reshape(pieces, -1)], pa.binary())], ["piece", "bits"])

    def either(t: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in t.column("bits").to_pylist()], axis=0)
        return pa.table({"piece": t.column("piece").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    rows = nodes.select("h").mapInArrow(build, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect()
    out = np.zeros((pieces, bits // 8 // pieces), np.uint8)
    for piece, b in rows:
        out[piece] = np.frombuffer(b, np.uint8)
    return out.ravel()


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    h = h.view(np.uint64)
    return [(x % np.uint64(bits)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """s and z, the compressed text of one document that has the set, for the sets in nodes (s, and h, the hash of the key
    of a document that has it)."""
    mask = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, pack = mask.value, zstandard.ZstdCompressor(3).compress
        for batch in small_batches(batches, "text"):
            hit = [(wanted[at >> 3] >> (at & 7)) & 1 for at in _bits(np.asarray(batch.column(1), dtype=np.int64), len(wanted) * 8)]
            pick = np.flatnonzero(hit[0] & hit[1])
            if not len(pick):
                continue
            texts = [t or "" for t in batch.column(0).take(pa.array(pick)).to_pylist()]
            found = [(_digest(s), pack(t.encode())) for s, t in zip(shingle_sets(texts), texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([z for _, z in found], pa.binary())], ["s", "z"])

    rows = docs.select("text", F.xxhash64("key").alias("h")).mapInArrow(run, "s binary, z binary")
    return rows.join(nodes.select("s"), "s", "left_semi").groupBy("s").agg(F.min("z").alias("z"))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of sets with link, whether they link: their texts meet and are made sets again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in small_batches(iter([whole]), "za"):
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                packed = dict(zip(a, batch.column(2).to_pylist())) | dict(zip(b, batch.column(3).to_pylist()))
                sets: dict[bytes, np.ndarray] = {}
                some, size = [], 0
                for s, z in [*packed.items(), (None, b"")]:
                    if some and (s is None or size > 8 << 20):
                        sets |= zip((x for x, _ in some), shingle_sets([t for _, t in some]))
                        some, size = [], 0
                    if s is not None:
                        some.append((s, unpack(z).decode()))
                        size += len(some[-1][1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([links(sets[x], sets[y]) for x, y in zip(a, b)], pa.bool_())], ["a", "b", "link"])

    left = texts.select(F.col("s").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("s").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary, link boolean")


def forest(edges: list[tuple]) -> dict:
    """The least node of the component of each node, roots left out."""
    up: dict = {}

    def root(x):
        at = x
        while (above := up.get(at, at)) != at:
            at = above
        while (above := up.get(x, x)) != at:
            up[x] = at
            x = above
        return at

    for u, v in edges:
        p, q = root(u), root(v)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(up)}


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: s and c, the least node of its component, for nodes that are not it.

    Each round, every task replaces its edges by a forest of stars (node, root). A node with several roots links them to
    the least one, and roots that have a root themselves are replaced by it. Rounds end when nothing changes, or when the
    stars that are left fit into one forest, which a single task then completes; the number of rounds grows with the
    logarithm of the longest chain. No task holds more than FOREST edges.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = forest(held)
            return pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["s", "c"])

        held, kind = [], None
        for batch in batches:
            kind = batch.column(0).type
            held += [(u, v) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if u != v]
            if len(held) >= FOREST:
                yield out()
                held = []
        if held:
            yield out()

    kind = edges.schema[a].dataType.simpleString()
    now = edges.select(F.col(a).alias("s"), F.col(b).alias("c"))
    old = None
    while True:
        now = written(now.mapInArrow(stars, f"s {kind}, c {kind}"), "join-stars")
        release(old)
        if now.count() < FOREST:
            done = written(now.coalesce(1).mapInArrow(stars, f"s {kind}, c {kind}"), "join-forest")
            release(now)
            return done
        least = now.groupBy("s").agg(F.min("c").alias("m"))
        above = least.select(F.col("s").alias("m"), F.col("m").alias("up"))
        told = now.join(least, "s").join(above, "m", "left")
        to = F.coalesce("up", "m")
        rows = told.select(F.explode(F.array(F.struct("s", to.alias("c")), F.struct(F.col("c").alias("s"), to.alias("c")), F.struct(F.col("m").alias("s"), to.alias("c")))).alias("e"), (F.col("up").isNotNull() | (F.col("c") != F.col("m"))).alias("moved"))
        new = written(rows.select("e.s", "e.c", "moved").filter("s <> c").groupBy("s", "c").agg(F.max("moved").alias("moved")), "join-labels")
        release(now)
        if new.filter("moved").isEmpty():
            return new.select("s", "c")
        now, old = new.select("s", "c"), new


def _can_link(p: str, q: str) -> Column:
    c = lambda x, n: F.col(f"{x}{n}")
    return (c(p, "n") <= c(q, "hi")) & (c(q, "n") <= c(p, "hi")) & (100 * c(p, "n") >= PERCENT * c(q, "n")) & (100 * c(q, "n") >= PERCENT * c(p, "n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles long, component_id (least doc_id reachable by links, itself included).

    Two documents link when their shingle sets have a Jaccard similarity of 0.8 or more. Null texts count as empty; a
    document without words has an empty set and links with nothing, so its component is itself. Repeated rows link with each
    other. A null doc_id stays null and is never the least; a component of null ids only has a null component_id. Whole
    texts are read, however long; an empty table gives an empty result. Shingles are compared by 64-bit hashes. Other
    columns are not read, so they may have any names.
    """
    found = _by_key(docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def _by_key(docs: DataFrame) -> DataFrame:
    """docs: key (of any ordered type), text. One row per row: key, n_shingles, component (least key)."""
    spark = docs.sparkSession
    signatures = written(_signatures(docs), "join-signatures")
    own = signatures.filter("kind = 0").select("key", "n", "s")
    counts = _sketch(signatures)
    total = int(counts.sum(dtype=np.int64))
    noise = int(np.median(counts)) if total else 0
    sketch = spark.sparkContext.broadcast(counts)
    parts = max(2 * partitions(spark), total // 5 // PART + 1)
    lists = written(_lists(_postings(docs, sketch, noise, parts), sketch, noise), "join-lists")
    by_set = own.filter("s IS NOT NULL").groupBy("s").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
    by_set = written(by_set, "join-sets")
    labels = _linked(docs, lists, by_set)
    release(lists)
    if labels is None:
        named = by_set.filter("copies > 1").select("s", F.col("least").alias("component"))
    else:
        told = by_set.join(labels, "s", "left").select("s", "copies", "least", F.coalesce("c", "s").alias("c"))
        roots = labels.select("c").distinct()
        groups = told.join(roots, "c", "left_semi").groupBy("c").agg(F.min("least").alias("lowest"))
        named = told.join(groups, "c", "left").filter("copies > 1 OR lowest IS NOT NULL").select("s", F.coalesce("lowest", "least").alias("component"))
    return own.join(named, "s", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))


def _linked(docs: DataFrame, lists: DataFrame, by_set: DataFrame) -> DataFrame | None:
    """Components (s, c) of the sets that have links; None if no set can link to another."""
    raw = lists.filter("kind = 0").select("g", F.col("t").alias("h"))
    pairs = raw.distinct()
    entries = lists.filter("kind = 1").select("t", "g", "n", "pos")
    members = lists.filter("kind = 2").select("g", "s", "n").distinct()
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    live = raw.select("g").union(raw.select(F.col("h").alias("g"))).union(entries.select("g")).distinct().withColumn("live", F.lit(True))
    nodes = members.join(groups.join(live, "g", "left").filter("live OR k > 1"), "g").select("g", "s", "n", "k")
    nodes = written(nodes.join(by_set.select("s", F.xxhash64("least").alias("h")), "s"), "join-nodes")
    if nodes.isEmpty():
        return None
    texts = written(_texts(docs, nodes), "join-texts")
    expand = nodes.select("g", "s", "k")
    both = pairs.join(expand.select("g", F.col("s").alias("a"), F.col("k").alias("ka")), "g")
    both = both.join(expand.select(F.col("g").alias("h"), F.col("s").alias("b"), F.col("k").alias("kb")), "h") if nodes.filter(F.col("k") > CROWD).isEmpty() else None
    within = nodes.filter("k > 1").select(F.col("g").alias("t"), "s", "n", F.lit(0).cast("long").alias("pos"))
    entries = entries.join(nodes.select("g", "s"), "g").select("t", "s", "n", "pos").union(within)
    if both is None:  # a pair with a large group becomes a list of its own instead of all pairs between them
        crowd = nodes.filter(F.col("k") > CROWD).select("g").distinct()
        large = pairs.join(crowd, "g", "left_semi").union(pairs.join(crowd.withColumnRenamed("g", "h"), "h", "left_semi").select("g", "h")).distinct()
        sides = large.select(F.xxhash64("g", "h").alias("t"), F.explode(F.array("g", "h")).alias("g"))
        entries = entries.union(sides.join(nodes.select("g", "s", "n"), "g").select("t", "s", "n", F.lit(0).cast("long").alias("pos")))
        left, right = expand.select("g", F.col("s").alias("a")), expand.select(F.col("g").alias("h"), F.col("s").alias("b"))
        both = pairs.join(large, ["g", "h"], "left_anti").join(left, "g").join(right, "h")
    direct = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    entries = entries.groupBy("t", "s").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    hi = F.floor((F.col("n") - F.col("pos")) * (100 + PERCENT) / PERCENT).cast("long") - F.col("n")
    entries = written(entries.withColumn("hi", hi), "join-entries")
    if entries.isEmpty():
        return _components_of(written(_compared(direct, texts), "join-compared"), None)
    # shared: which part of its prefix a set shares with others; the least edited of copies shares the most
    shared = entries.groupBy("s").agg((F.count(F.lit(1)) / (F.floor(F.max("n") / 5) + 1)).alias("shared"))
    entries, first = written(entries.join(shared, "s"), "join-live"), entries
    release(first)
    labels, compared = None, None
    for turn in range(ROUNDS + 1):
        columns = lambda p: [F.col(x).alias(f"{p}{x}") for x in ("s", "n", "hi", "c")]
        last, open_ = turn == ROUNDS, entries.withColumn("c", F.col("s"))
        if turn:  # before that every set is its own component and every list is open
            now = entries if labels is None else entries.join(labels, "s", "left")
            now = now.withColumn("c", F.col("s") if labels is None else F.coalesce("c", "s"))
            ends = now.groupBy("t").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("n").alias("low"), F.max("hi").alias("top"))
            open_ = now.join(ends.filter("x <> y").select("t", "low", "top"), "t").filter("hi >= low AND n <= top").drop("low", "top")
            open_ = written(open_, "join-open")
            # pairs that are left, at most: of a list all pairs less those within its components
            size = open_.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("inner"))
            rows, left = size.agg(F.sum("m"), F.sum(F.col("m") * F.col("m") - F.col("inner"))).first()
            if not rows or not left:
                release(open_)
                break
            last = last or left // 2 <= 16 * rows
        if last:
            p, q = open_.select("t", *columns("p_")), open_.select("t", *columns("q_"))
            found = p.join(q, "t").filter((F.col("p_s") < F.col("q_s")) & (F.col("p_c") != F.col("q_c")) & _can_link("p_", "q_")).select(F.col("p_s").alias("a"), F.col("q_s").alias("b"))
        else:
            rank = F.struct("shared", F.xxhash64("s", F.lit(turn)).alias("h")) if turn < 2 else F.struct(F.xxhash64("s", F.lit(turn)).alias("h"), "shared")
            leader = open_.groupBy("t").agg(F.max_by(F.struct(*columns("q_"), F.col("shared").alias("q_shared")), rank).alias("q"))
            found = open_.select("t", *columns("p_")).join(leader.select("t", "q.*"), "t").filter((F.col("p_c") != F.col("q_c")) & _can_link("p_", "q_"))
            if turn == 0:  # at first only the best leader of each set
                found = found.groupBy("p_s").agg(F.max_by("q_s", F.struct("q_shared", "q_s")).alias("q_s"))
            found = found.select(F.least("p_s", "q_s").alias("a"), F.greatest("p_s", "q_s").alias("b"))
        found = found.union(direct) if turn == 0 else found
        found = found.distinct() if compared is None else found.distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_compared(found, texts), "join-compared")
        labels = _components_of(new, labels)
        compared = new if compared is None else compared.union(new)
        if turn:
            release(open_)
        if last:
            break
    return labels


def _components_of(compared: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """Components over the links among compared and those known."""
    found = compared.filter("link").select("a", "b")
    if found.isEmpty():
        return known
    return components(found if known is None else found.union(known.select("s", "c")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, with all its columns: one with the least doc_id, a null id last; of rows that
    share the least id any one. Rows are told apart by their place, so repeated and null ids don't matter, nor do the names
    of other columns. Rows without words are components of their own and all stay."""
    file, row = fresh(docs.columns, "__file", "__row")
    rows = with_place(docs, file, row, "join-rows")
    number = F.col(f"`{id_col}`").cast("long")
    key = F.struct(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))
    found = _by_key(rows.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")))
    dropped = found.filter("key <> component").select(F.col("key.file").alias(file), F.col("key.row").alias(row))
    return rows.join(written(dropped, "join-dropped"), [file, row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
