"""Seed bundles: JSON files of observations, concepts and relations that are put into a store without extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import graph, history

BUNDLE = (
    "observations array<struct<id: string, subject: string, predicate: string, object: string, evidence: string, workspace: string, source: string>>, "
    "concepts array<struct<id: string, name: string, definition: string, entities: array<string>, workspace: string, lifecycle_scope: string, scope_key: string, confidence: double>>, "
    "relations array<struct<src: string, dst: string, relation_type: string, workspace: string>>"
)
#: Relation types of bundles that are stored as another type; unknown ones are shared entities.
STORED_AS = {"shared_session": "shared_session", "temporal": "temporal", "embedding_similarity": "embedding_similarity"}


@dataclass
class Bundle:
    observations: DataFrame
    concepts: DataFrame
    relations: DataFrame


def read_bundles(spark: SparkSession, path: str) -> Bundle:
    """Bundles of a JSON file, or of all *.json below a folder."""
    return parsed(spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("source_ref"), F.col("value").alias("content")))


def parsed(files: DataFrame) -> Bundle:
    """files: source_ref, content. Missing fields get their defaults; a file that is no bundle is an error."""
    told = files.withColumn("b", F.from_json("content", BUNDLE))
    good = F.when(F.col("b").isNull() | ~F.ltrim("content").startswith("{"), F.raise_error(F.concat(F.lit("no seed bundle: "), "source_ref")).cast(told.schema["b"].dataType)).otherwise(F.col("b"))
    told = told.select("source_ref", good.alias("b"))
    part = lambda name: told.select("source_ref", F.posexplode(F.col("b")[name]).alias("place", "x")).select("source_ref", "place", "x.*")
    value = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise))
    obs, con, rel = part("observations"), part("concepts"), part("relations")
    return Bundle(
        obs.withColumns({"workspace": value("workspace", "default"), "source": value("source", "file_evidence")}),
        con.withColumns({"workspace": value("workspace", "default"), "lifecycle_scope": value("lifecycle_scope", "project"), "confidence": value("confidence", 0.85), "entities": F.coalesce("entities", F.array().cast("array<string>"))}),
        rel.withColumns({"workspace": value("workspace", "default"), "relation_type": value("relation_type", "causal")}),
    )


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("source_ref", "place")).alias("__f"))
    return first.select(*key, "__f.*")


def raw_rows(bundle: Bundle, now: str) -> DataFrame:
    """The messages that seeded observations go back to."""
    return _once(bundle.observations, ["id"]).select(
        F.concat(F.lit("seed-"), "id").alias("memory_id"), F.col("workspace").alias("workspace_id"), F.concat(F.lit("seed-"), "workspace").alias("session_id"), F.lit("system").alias("role"), F.col("evidence").alias("content"),
        F.lit("manual").alias("source_type"), F.lit("corpus-seed").alias("source_ref"), F.lit("seed.v1").alias("extraction_version"), F.lit(now).alias("created_at"),
    )


def observation_rows(bundle: Bundle, now: str) -> DataFrame:
    """Seeded observations: confirmed, with the evidence of their source and that of a file besides. Texts stay as given."""
    source = F.when(F.col("source").isin("user_confirm", "user_negation", "assistant_guess", "user_message"), F.col("source")).otherwise("file_evidence")
    alpha, beta = S.evidence_seed(source)
    extra = vocab.EVIDENCE["file_evidence"]
    return _once(bundle.observations, ["id"]).select(
        F.concat(F.lit("obs-"), "id").alias("observation_id"), F.col("workspace").alias("workspace_id"), F.concat(F.lit("seed-"), "id").alias("memory_id"), F.col("subject").alias("subject_text"), "predicate", F.col("object").alias("object_text"),
        F.col("evidence").alias("evidence_text"), S.looked_up(source, vocab.TRUST, 0.3).alias("extraction_confidence"), (alpha + extra[0]).alias("evidence_alpha"), (beta + extra[1]).alias("evidence_beta"), F.lit("confirmed").alias("status"),
        F.lit(0.4).alias("surprise_score"), source.alias("source_type"), F.lit(False).alias("consolidated"), F.concat(F.lit("seed-batch-"), "workspace").alias("extraction_batch_id"), F.lit(None).cast("string").alias("superseded_by"), F.lit(1).cast("long").alias("cross_project_count"), F.lit(now).alias("created_at"),
    )


def concept_rows(bundle: Bundle, now: str) -> DataFrame:
    """Seeded concepts: active, Beta(5, 1), recalled once with success."""
    scope = F.when(F.col("lifecycle_scope").isin("global", "domain"), F.col("lifecycle_scope")).otherwise("project")
    count = lambda n: F.lit(n).cast("long")
    return _once(bundle.concepts, ["id"]).select(
        F.col("id").alias("concept_id"), F.col("workspace").alias("workspace_id"), "name", "definition", F.col("entities").alias("related_entities"), "confidence", F.lit(5.0).alias("evidence_alpha"), F.lit(1.0).alias("evidence_beta"), F.lit("active").alias("status"),
        count(0).alias("hierarchy_depth"), count(1).alias("recall_count"), count(1).alias("successful_recall_count"), count(0).alias("failed_recall_count"), count(0).alias("connection_count"), scope.alias("lifecycle_scope"), "scope_key", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def relation_events(bundle: Bundle) -> DataFrame:
    """The evidence that seeded relations are: one repeated occurrence for each edge."""
    kind = F.lit("shared_entity")
    for name, stored in STORED_AS.items():
        kind = F.when(F.col("relation_type") == name, stored).otherwise(kind)
    src, dst = S.canonical_pair(F.col("src"), F.col("dst"), F.col("kind"))
    rows = bundle.relations.filter("src <> dst").withColumn("kind", kind)
    return rows.select(F.col("workspace").alias("workspace_id"), src.alias("src"), dst.alias("dst"), F.col("kind").alias("relation_type"), F.lit("repeated_occurrence").alias("evidence")).distinct()


def applied(bundle: Bundle, stored: dict[str, DataFrame], now: str) -> dict[str, DataFrame]:
    """What a bundle adds to a store: new rows of raw_memory, observation, concept and concept_relation, whose keys are not
    stored yet, and timeline events, which come anew each time."""
    new = lambda rows, table, key: rows.join(stored[table].select(*key), key, "left_anti")
    events = relation_events(bundle)
    edge = ["workspace_id", "src", "dst", "relation_type"]
    obs = observation_rows(bundle, now)
    return {
        "raw_memory": new(raw_rows(bundle, now), "raw_memory", ["memory_id"]),
        "observation": new(obs, "observation", ["observation_id"]),
        "concept": new(concept_rows(bundle, now), "concept", ["concept_id"]),
        "concept_relation": graph.fold_edges(new(events, "concept_relation", edge)),
        "timeline": history.from_observations(obs, F.lit(now)).withColumn("kind", F.lit("append")),
    }
