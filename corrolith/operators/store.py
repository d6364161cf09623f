"""Writes as new snapshots: inserts, updates by key, deletes and the checks before them. Nothing is changed in place: each
function takes tables and gives the table after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S


class DuplicateKey(ValueError):
    """A key that must be new is stored already, or comes twice."""


class MissingKey(KeyError):
    """A row that is to be changed is not stored."""


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def insert_or_ignore(rows: DataFrame, stored: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows that an insert adds: keys that are not stored, each once, the first in order."""
    return first_of(rows, key, order).join(stored.select(*key), key, "left_anti")


def upsert(rows: DataFrame, stored: DataFrame, key: list[str], order: list) -> DataFrame:
    """stored after an insert that replaces rows of the same key; of several new rows of a key the last in order counts."""
    new = first_of(rows, key, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """stored without the rows of the keys; keys that are not stored change nothing."""
    return stored.join(keys.select(*key).distinct(), key, "left_anti")


def get(stored: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return stored.filter(F.col(key) == value)


def append_strict(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """stored with the rows added. A key that is stored already or comes twice is an error, found before anything is added."""
    both = stored.select(key).union(rows.select(key))
    twice = rows.select(key).distinct().join(both.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), key, "left_semi").limit(1).collect()
    if twice:
        raise DuplicateKey(f"{key} {twice[0][0]!r} is there already")
    return stored.unionByName(rows)


def update(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with columns taken from changes (one row per key). A key that is not stored is an error."""
    gone = changes.select(key).join(stored.select(key), key, "left_anti").limit(1).collect()
    if gone:
        raise MissingKey(f"{key} {gone[0][0]!r} is not stored")
    new = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = stored.join(new, key, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*stored.columns)


def supersede(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observations with those in pairs (observation_id, by) superseded by another."""
    told = pairs.select("observation_id", F.lit("superseded").alias("status"), F.col("by").alias("superseded_by"))
    return update(obs, told, "observation_id", ["status", "superseded_by"])


def consolidated(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Observations with those of ids marked as looked through by maintenance."""
    return update(obs, ids.select("observation_id").distinct().withColumn("consolidated", F.lit(True)), "observation_id", ["consolidated"])


def replace_session(obs: DataFrame, superseded: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after a session's rows have been superseded (as planner.superseded_sessions gives them) and new ones added."""
    return obs.join(superseded.select("observation_id"), "observation_id", "left_anti").unionByName(superseded, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def with_cross_counts(obs: DataFrame, counts: DataFrame) -> DataFrame:
    """Observations with the counts of ledger.cross_workspace_count written back; rows that are not live keep theirs."""
    n = counts.select("observation_id", F.col("cross_project_count").alias("__n"))
    return obs.join(n, "observation_id", "left").withColumn("cross_project_count", F.coalesce("__n", "cross_project_count")).drop("__n")


# ---- recall ----


def record_recalls(concepts: DataFrame, events: DataFrame) -> DataFrame:
    """Concepts after recalls (concept_id, at): each counts once and the last one sets the clock. Whether a recall helped is
    told by feedback later."""
    n = events.groupBy("concept_id").agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    out = concepts.join(n, "concept_id", "left")
    return out.withColumns({"recall_count": F.col("recall_count") + F.coalesce("__n", F.lit(0)), "last_recalled_at": F.coalesce("__at", "last_recalled_at")}).drop("__n", "__at")


def record_outcomes(concepts: DataFrame, events: DataFrame) -> DataFrame:
    """Concepts after outcomes of recalls (concept_id, success)."""
    n = events.groupBy("concept_id").agg(F.sum(F.col("success").cast("long")).alias("__good"), F.sum((~F.col("success")).cast("long")).alias("__bad"))
    out = concepts.join(n, "concept_id", "left")
    return out.withColumns({"successful_recall_count": F.col("successful_recall_count") + F.coalesce("__good", F.lit(0)), "failed_recall_count": F.col("failed_recall_count") + F.coalesce("__bad", F.lit(0))}).drop("__good", "__bad")


# ---- edges ----


def new_edges(pairs: DataFrame, now: str) -> DataFrame:
    """Edges as they begin, from pairs (workspace_id, a, b, relation_type): ends in their stored order, one alpha and one
    beta, no evidence. An edge from a concept to itself, or of an unknown type, is an error."""
    src, dst = S.canonical_pair(F.col("a"), F.col("b"), F.col("relation_type"))
    bad = pairs.filter((F.col("a") == F.col("b")) | ~F.col("relation_type").isin(*vocab.RELATION_TYPES)).limit(1).collect()
    if bad:
        raise ValueError(f"no such edge: {bad[0].asDict()}")
    rows = pairs.select("workspace_id", src.alias("src"), dst.alias("dst"), "relation_type").distinct()
    ident = F.concat(F.lit("rel-"), F.md5(F.concat_ws("\x00", "workspace_id", "src", "dst", "relation_type")))
    return rows.select(ident.alias("relation_id"), "*", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).cast("long").alias("evidence_count"), F.lit("candidate").alias("lifecycle"), F.lit(now).alias("created_at"))


def with_connections(concepts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Concepts with connection_count raised by the edges that are new, at both ends."""
    key = ["workspace_id", "src", "dst", "relation_type"]
    new = after.select(*key).join(before.select(*key), key, "left_anti")
    n = new.select(F.explode(F.array("src", "dst")).alias("concept_id")).groupBy("concept_id").agg(F.count(F.lit(1)).alias("__n"))
    return concepts.join(n, "concept_id", "left").withColumn("connection_count", F.col("connection_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def edges_of(edges: DataFrame, workspace: str) -> DataFrame:
    """Edges of a workspace; a listing sorts them by listing_order()."""
    return edges.filter(F.col("workspace_id") == workspace)


def listing_order(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Rows in the order of a listing; the last step before they are shown."""
    return df.orderBy(*columns)


# ---- references ----


def reference_violations(edges: DataFrame, concepts: DataFrame, feedback: DataFrame, obs: DataFrame, raw: DataFrame) -> DataFrame:
    """References without a target: relation, reference, value. Null references are no violation."""
    c, m = concepts.select(F.col("concept_id").alias("value")), raw.select(F.col("memory_id").alias("value"))
    parts = [(edges, "src", "edge.src", c), (edges, "dst", "edge.dst", c), (feedback, "concept_id", "feedback.concept", c), (obs, "memory_id", "observation.memory", m)]
    out = None
    for rows, column, name, target in parts:
        own = rows.select(F.lit(name).alias("reference"), F.col(column).alias("value")).filter("value IS NOT NULL").distinct().join(target, "value", "left_anti").select("reference", "value")
        out = own if out is None else out.union(own)
    return out
