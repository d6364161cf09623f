"""Operators over the observation ledger: listing, counting, corroboration, coclaims, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions.scalars import effective_confidence, fact_confidence

TRIPLE = ("subject_text", "predicate", "object_text")


def live(obs: DataFrame) -> DataFrame:
    return obs.filter(~F.col("status").isin(*vocab.DEAD))


def strict(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("status").isin(*vocab.STRICT))


def by_status(obs: DataFrame, workspace: str, status: str | None = None) -> DataFrame:
    """Rows of a workspace, of one status if given. An unknown status is an error."""
    if status is not None and status not in vocab.OBSERVATION_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    own = obs.filter(F.col("workspace_id") == workspace)
    return own if status is None else own.filter(F.col("status") == status)


def by_entity(obs: DataFrame, workspace: str, entity: str) -> DataFrame:
    """Rows of any status that name the entity as subject or object."""
    return obs.filter((F.col("workspace_id") == workspace) & ((F.col("subject_text") == entity) | (F.col("object_text") == entity)))


def null_safe(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; the keys of a stay."""
    renamed = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        one = a[k].eqNullSafe(renamed[f"__{k}"])
        on = one if on is None else on & one
    return a.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def cross_workspace_count(obs: DataFrame) -> DataFrame:
    """Adds cross_project_count to live rows: in how many workspaces the triple is live. Pairs of triple and workspace are
    made distinct before counting, so a triple that everyone repeats is combined on the map side."""
    rows = live(obs)
    counts = rows.select(*TRIPLE, "workspace_id").distinct().groupBy(*TRIPLE).agg(F.greatest(F.count("workspace_id"), F.lit(1)).alias("cross_project_count"))
    return null_safe(rows, counts, TRIPLE)


def oldest_live(obs: DataFrame) -> DataFrame:
    """Of each live triple of a workspace with more than one row, the oldest id and the number of rows."""
    groups = live(obs).groupBy("workspace_id", *TRIPLE).agg(F.min(F.struct("created_ts", "observation_id")).alias("first"), F.count("*").alias("n_rows"))
    return groups.filter("n_rows > 1").select("workspace_id", *TRIPLE, F.col("first.observation_id").alias("observation_id"), "n_rows")


def coclaim_pairs(obs: DataFrame) -> DataFrame:
    """Pairs of observations of one extraction batch, smaller id first. Batches are small by construction: one per call."""
    ids = obs.filter("extraction_batch_id IS NOT NULL").select("extraction_batch_id", "observation_id").distinct()
    # an observation has one batch, so a pair of one batch is met once
    a, b = ids.withColumnRenamed("observation_id", "a"), ids.withColumnRenamed("observation_id", "b")
    return a.join(b, "extraction_batch_id").filter("a < b").select("a", "b")


def coclaim_siblings(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Live rows that share a batch with one of ids (observation_id), themselves left out."""
    wanted = ids.select("observation_id").distinct()
    batches = obs.join(wanted, "observation_id", "left_semi").select("extraction_batch_id").distinct()
    return live(obs).join(batches, "extraction_batch_id", "left_semi").join(wanted, "observation_id", "left_anti")


def version_mode(raw: DataFrame) -> DataFrame:
    """The most frequent extraction version of each session; of equally frequent ones the smallest."""
    n = raw.filter("extraction_version IS NOT NULL").groupBy("workspace_id", "session_id", "extraction_version").count()
    best = n.groupBy("workspace_id", "session_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "extraction_version")).alias("best"))
    return best.select("workspace_id", "session_id", F.col("best.extraction_version").alias("extraction_version"), (-F.col("best.n")).alias("n_messages"))


def duplicates(obs: DataFrame) -> DataFrame:
    """Strictly live triples of a workspace with more than one row."""
    return strict(obs).groupBy("workspace_id", *TRIPLE).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def conflicts(obs: DataFrame) -> DataFrame:
    """Subjects and objects of a workspace for which a predicate and its negation are both live; negated: how many."""
    both = [F.max(F.col("predicate") == p) & F.max(F.col("predicate") == q) for p, q in vocab.NEGATIONS]
    total = sum((b.cast("int") for b in both[1:]), both[0].cast("int"))
    return strict(obs).groupBy("workspace_id", "subject_text", "object_text").agg(total.alias("n_conflicts")).filter("n_conflicts > 0")


def low_value(obs: DataFrame, alpha: float = 1.2, confidence: float = 0.45) -> DataFrame:
    return strict(obs).filter((F.col("source_type") == "assistant_guess") & (F.col("evidence_alpha") <= alpha) & (fact_confidence() < confidence))


def maintained(obs: DataFrame) -> DataFrame:
    """State of strictly live rows after one pass of maintenance: of equal triples the strongest stays and gains one alpha
    for each other; where a predicate and its negation meet, the rows that stay have their first alpha and two more beta;
    weak guesses are deprecated. Triples are aggregated and joined back, so a frequent one is combined before it meets."""
    rows = strict(obs).withColumn("eff", effective_confidence())
    best = rows.groupBy("workspace_id", *TRIPLE).agg(F.min(F.struct((-F.col("eff")).alias("e"), "observation_id")).alias("b"), F.count("*").alias("n"))
    ranked = null_safe(rows, best.select("workspace_id", *TRIPLE, F.col("b.observation_id").alias("keep"), "n"), ("workspace_id", *TRIPLE))
    hit = conflicts(obs).select("workspace_id", "subject_text", "object_text", F.lit(True).alias("conflict"))
    out = null_safe(ranked, hit, ("workspace_id", "subject_text", "object_text"), "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    stays = F.col("observation_id") == F.col("keep")
    weak = (F.col("source_type") == "assistant_guess") & (F.col("evidence_alpha") <= 1.2) & (fact_confidence() < 0.45)
    return out.select(
        "observation_id", "workspace_id",
        F.when(stays & ~F.col("conflict"), F.col("evidence_alpha") + F.col("n") - 1).otherwise(F.col("evidence_alpha")).alias("evidence_alpha"),
        F.when(stays & F.col("conflict"), F.col("evidence_beta") + 2).otherwise(F.col("evidence_beta")).alias("evidence_beta"),
        F.when(~stays, "superseded").when(weak, "deprecated").otherwise(F.col("status")).alias("status"),
        F.when(~stays, F.concat(F.lit("dream-merge:"), "keep")).alias("superseded_by"), F.lit(True).alias("consolidated"), F.col("conflict").alias("softened"),
    )


def after_maintenance(obs: DataFrame) -> DataFrame:
    """The whole ledger after maintained(); rows that are not strictly live stay as they are."""
    new = maintained(obs).drop("workspace_id", "softened")
    columns = [c for c in new.columns if c != "observation_id"]
    out = obs.join(new.select("observation_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns]), "observation_id", "left")
    for c in columns:
        was = F.col(c) if c in obs.columns else F.lit(None).cast(new.schema[c].dataType)
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(was))
    return out.drop("__hit", *[f"__{c}" for c in columns])


def maintenance_report(state: DataFrame) -> DataFrame:
    """What maintained() did in each workspace: rows merged away, softened, archived and looked through."""
    count = lambda c: F.sum(c.cast("long"))
    live_ = F.col("status") != "superseded"
    return state.groupBy("workspace_id").agg(count(~live_).alias("merged"), count(live_ & F.col("softened")).alias("softened"), count(F.col("status") == "deprecated").alias("archived"), F.count(F.lit(1)).alias("consolidated"))


def of_triple(obs: DataFrame, subject: str, predicate: str, obj: str | None) -> DataFrame:
    """Live rows of a triple in any workspace; a null object is one of its own."""
    return live(obs).filter((F.col("subject_text") == subject) & (F.col("predicate") == predicate) & F.col("object_text").eqNullSafe(F.lit(obj)))


def missing_references(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference has no target; null references are no violation."""
    known = target.select(F.col(target_key).alias(key)).distinct()
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left_anti")
