"""Similarity of vectors: top-k, connected components, and the fusion of ranked lists. Pairs are in clusters."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrolith.functions.scalars import cosine


def topk(vectors: DataFrame, query: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """The k rows most like the one query vector; of a source_id with several types the first type counts. The query is a
    single row, so it is broadcast; the top k is kept in each partition before the merge."""
    one = query.select(F.col("vector").alias("__q")).limit(1)
    first = vectors.groupBy("source_id").agg(F.min_by("vector", "source_type").alias("vector"))
    scored = first.join(F.broadcast(one)).select("source_id", cosine(F.col("vector"), F.col("__q")).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "source_id").limit(k)


def forest(edges: list[tuple]) -> dict:
    """The least node of the component of each node that is not it."""
    up: dict = {}

    def root(x):
        at = x
        while (above := up.get(at, at)) != at:
            at = above
        while (above := up.get(x, x)) != at:
            up[x], x = at, above
        return at

    for u, v in edges:
        p, q = root(u), root(v)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(up)}


#: Edges that a task's forest holds at once.
HELD = 500_000


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable from it over pairs (a, b).

    Each round, every task replaces its edges by a forest of stars. A node with several roots links them to the least one,
    and roots that have a root themselves are replaced by it, until nothing changes; rounds grow with the logarithm of the
    longest chain. Lineage is cut by checkpoint(), so the session needs a checkpoint folder: see checkpointed().
    """
    kind = nodes.schema["node"].dataType.simpleString()

    def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        shown = lambda: pd.DataFrame(list(forest(held).items()), columns=["s", "c"])
        for f in frames:
            held += [(u, v) for u, v in zip(f["s"], f["c"]) if u != v]
            if len(held) >= HELD:
                yield shown()
                held = []
        if held:
            yield shown()

    now = pairs.select(F.col("a").cast(kind).alias("s"), F.col("b").cast(kind).alias("c"))
    while True:
        now = checkpointed(now.mapInPandas(stars, f"s {kind}, c {kind}"))
        least = now.groupBy("s").agg(F.min("c").alias("m"))
        told = now.join(least, "s").join(least.select(F.col("s").alias("m"), F.col("m").alias("up")), "m", "left")
        to = F.coalesce("up", "m")
        ends = F.explode(F.array("s", "c", "m"))
        rows = told.select(ends.alias("s"), to.alias("c"), (F.col("up").isNotNull() | (F.col("c") != F.col("m"))).alias("moved"))
        new = checkpointed(rows.filter("s <> c").groupBy("s", "c").agg(F.max("moved").alias("moved")))
        if new.filter("moved").isEmpty():
            return nodes.join(new.select(F.col("s").alias("node"), "c"), "node", "left").select("node", F.coalesce("c", "node").alias("label"))
        now = new.select("s", "c")


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the checkpoint folder. Where the session names none, a temporary one in local mode, where all tasks
    share the driver's disk; on a cluster that is an error."""
    _checkpoint_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), but by columns and compressed, for large tables; removed when the driver ends. Joins sort it."""
    path = f"{_checkpoint_folder(df)}/stored-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return sorted_in_joins(df.sparkSession.read.schema(df.schema).parquet(path))


def sorted_in_joins(df: DataFrame) -> DataFrame:
    """df for joins that sort both sides. Spark takes the size of compressed files for that of their rows, and would gather a
    table of many times its limit in the driver to send it to all executors."""
    return df.hint("merge")


def _checkpoint_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corrolith-"))
    return sc.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    try:
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is scratch space
        pass


def fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (id, rank from 0) of any number of lists."""
    return ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def within_budget(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes add up to the budget at most."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)
