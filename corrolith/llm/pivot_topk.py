"""Exact top-k search by inner product with pivot-table elimination.

A table of pivots is fixed, and the distance of every vector to every pivot is computed beforehand and kept with the vector.
By the triangle inequality the largest difference between a query's and a candidate's distances to a pivot bounds their
distance from below, and with both norms bounds their inner product from above. Candidates are evaluated in the order of
this bound until the next bound is below the k-th score found. Blocks hold vectors that are nearest to one pivot. Queries
first meet a block of their own pivot, which gives each a score that its k best must reach, and then all blocks: each pair of
a query block and a candidate block gives its own top k, if any bound in it reaches that score, and the k best of all these
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith.llm.common import written

#: Rows in a block of candidates and of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 256
#: Candidates evaluated at once, in bound order.
STEP = 64
#: Sums of products up to this size are exact in 64-bit floats.
EXACT = float(1 << 53)


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component as long; null if the vector is null or holds a null or a non-finite component."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024.0).cast("long")))


def measured(rows: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, vec) with dim, vecs (the vector's bytes), dists (its distances to the pivots of its dimension) and near,
    the nearest pivot. A dimension without pivots has one, the origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype="<i8")
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            flat = np.asarray(batch.column(1).flatten(), dtype="<i8")
            begin = np.append(0, np.cumsum(sizes))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = np.stack([flat[begin[i] : begin[i + 1]] for i in at]).reshape(len(at), dim)
                d = distances(x, tables.get(dim, np.zeros((1, dim))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in d], pa.binary()), pa.array(d.argmin(1).astype(np.int32))], ["vec_id", "dim", "vecs", "dists", "near"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, dim int, vecs binary, dists binary, near int")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row per block: dim, near, part, and ids, vectors, distances and, where rows have it, least as binary. The vectors of
    a pivot are dealt over as many blocks of about `size` as they need."""
    more = ["least"] * ("least" in rows.columns)
    counts = rows.groupBy("dim", "near").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
    # equal rows share a hash, so rows are dealt by a number that differs within them
    dealt = rows.withColumn("__n", F.monotonically_increasing_id()).join(F.broadcast(counts), ["dim", "near"])  # pivots times dimensions
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("__n"), F.col("parts")))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        blob = lambda b: pa.array([b], pa.binary())
        out = {"dim": pa.array([key[0].as_py()], pa.int32()), "near": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int64()), "ids": blob(np.asarray(t.column("vec_id"), dtype="<i8").tobytes())}
        out |= {c: blob(b"".join(t.column(c).to_pylist())) for c in ("vecs", "dists")}
        return pa.table(out | {c: blob(np.asarray(t.column(c), dtype="<f8").tobytes()) for c in more})

    schema = "dim int, near int, part long, ids binary, vecs binary, dists binary" + ", least binary" * len(more)
    return dealt.select("dim", "near", "part", "vec_id", "vecs", "dists", *more).groupBy("dim", "near", "part").applyInArrow(pack, schema)


def distances(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    xf = x.astype(np.float64)
    return np.sqrt(np.maximum(0, (xf * xf).sum(1)[:, None] + (table * table).sum(1) - 2 * xf @ table.T))


def pivots(dim: int, vectors: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Pivots far from each other, chosen greedily from given vectors, or at random along the axes if there are none."""
    rng = np.random.default_rng(seed)
    if not len(vectors):
        return rng.normal(0, 1024, (count, dim))
    chosen = [vectors[0]]
    far = ((vectors - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(vectors)):
        chosen.append(vectors[int(far.argmax())])
        far = np.minimum(far, ((vectors - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows, exact while they fit 64 bits."""
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if peak < EXACT else x @ q


def search_block(qids: np.ndarray, q: np.ndarray, dq: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Top k of each query within a block: query ids, vector ids, scores, and how many products were made.

    dq and dx: distances to the pivots. least: a score of each query that its k best reach; lower ones need not be found.
    Bounds are widened by a rounding margin, so elimination never loses a candidate.
    """
    nx, nq = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    far = max(dx.max(initial=0), dq.max(initial=0))
    slack = 1e-6 * (1 + nx.max(initial=0) + nq.max(initial=0) + far * far)
    least = np.full(len(q), -np.inf) if least is None else least
    out_q, out_v, out_s, made = [], [], [], 0
    for i in range(len(q)):
        low = np.zeros(len(x))
        for j in range(dx.shape[1]):
            np.maximum(low, np.abs(dx[:, j] - dq[i, j]), out=low)
        upper = (nx + nq[i] - low * low) / 2 + slack
        live = np.flatnonzero(upper >= least[i])
        order = live[np.argsort(-upper[live], kind="stable")]
        best_v, best_s, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STEP
        while at < len(order):
            if len(best_s) >= k and upper[order[at]] < best_s[-1]:
                break
            some = order[at : at + step]
            at, step = at + step, step * 2
            some = some[ids[some] != qids[i]]
            made += len(some)
            v, s = np.concatenate([best_v, ids[some]]), np.concatenate([best_s, _products(q[i], x[some])])
            top = np.lexsort((v, -s))[:k]
            best_v, best_s = v[top], s[top]
        out_q.append(np.full(len(best_v), qids[i]))
        out_v.append(best_v)
        out_s.append(best_s)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(out_q), join(out_v), join(out_s), made


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Top k of each pair of a query block (qids, qvecs, qdists, qleast) and a candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                dim = r["dim"]
                ids, qids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["qids"], "<i8")
                x, q = np.frombuffer(r["vecs"], "<i8").reshape(len(ids), dim), np.frombuffer(r["qvecs"], "<i8").reshape(len(qids), dim)
                dx, dq = np.frombuffer(r["dists"]).reshape(len(ids), -1), np.frombuffer(r["qdists"]).reshape(len(qids), -1)
                a, b, s, _ = search_block(qids, q, dq, ids, x, dx, k, np.frombuffer(r["qleast"]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return pairs.select("dim", "ids", "vecs", "dists", "qids", "qvecs", "qdists", "qleast").mapInArrow(run, "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column | str = "vec_id % 100 = 0", k: int = 10, n_pivots: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its k best other rows by inner product of floor(1024 * x): query_id, rank (from 1), vec_id, score.

    is_query is a condition on vec_id. Vectors that are null, or hold a null or non-finite component, and rows with a null
    id take no part; vectors of different lengths are not compared, nor a row with rows of its own id; ties go to the
    smaller vec_id; a repeated row is a candidate as often as it comes, and asks once, with the least vector of its id. Fewer
    candidates than k give all of them; an empty table, or one without queries, gives none. Components beyond 64 bits are held
    at their limits. Other columns are not read, so they may have any names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("vec")).filter("vec is not null and vec_id is not null")
    rows = written(rows, "topk-vectors")
    # a fixed sample of rows by hash gives the pivots; what is sampled changes the speed only
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id")).select("vec").limit(512).collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    tables = {dim: pivots(dim, np.array(v, np.float64).reshape(len(v), dim), n_pivots) for dim, v in sample.items()}
    condition = F.expr(is_query) if isinstance(is_query, str) else is_query
    asked = rows.filter(condition).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    schema = "query_id long, rank int, vec_id long, score long"
    if not sample or asked.isEmpty():
        return spark.createDataFrame([], schema)
    candidates = written(_packed(measured(rows, tables), CANDIDATE_BLOCK), "topk-blocks")
    asked = written(measured(asked, tables).withColumn("least", F.lit(float("-inf"))), "topk-queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # what one block of the own pivot gives a query is a score that its k best reach
    first = _searched(_asking(asked).withColumnRenamed("qnear", "near").join(candidates.filter("part = 0"), ["dim", "near"]), k)
    reached = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    asked = written(asked.drop("least").join(reached, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "topk-least")
    # the stated queries meet all blocks of their dimension
    found = _searched(_asking(asked).join(candidates, "dim"), k)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _asking(asked: DataFrame) -> DataFrame:
    """Blocks of queries under names of their own."""
    return _packed(asked, QUERY_BLOCK).select("dim", F.col("near").alias("qnear"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"), F.col("dists").alias("qdists"), F.col("least").alias("qleast"))
