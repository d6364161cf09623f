"""Schemas of the stored tables, and the version of their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised with every change of a schema; MIGRATIONS tells what each version added.
VERSION = 3

_EVIDENCE = "evidence_alpha double, evidence_beta double"
_RECALLS = "last_recalled_at string, recall_count long, successful_recall_count long, failed_recall_count long"
_LISTS = "known_facts array<string>, rejected_hypotheses array<string>, open_questions array<string>, evidence array<string>"

#: Columns of each table, in order.
SCHEMAS = {
    "raw_memory": "memory_id string, workspace_id string, session_id string, role string, content string, source_type string, source_ref string, extraction_version string, created_at string",
    "observation": f"observation_id string, workspace_id string, memory_id string, subject_text string, subject_type string, predicate string, object_text string, object_type string, evidence_text string, extraction_confidence double, {_EVIDENCE}, "
    "status string, surprise_score double, source_type string, consolidated boolean, memory_type_candidate string, observation_detail_json string, extraction_batch_id string, superseded_by string, cross_project_count long, created_at string",
    "concept_candidate": f"candidate_id string, workspace_id string, name string, summary string, source_terms array<string>, source_sessions array<string>, source_observations array<string>, {_LISTS}, evidence_count long, confidence double, {_EVIDENCE}, status string, {_RECALLS}, created_at string, updated_at string",
    "concept": f"concept_id string, workspace_id string, name string, concept_type string, definition string, related_entities array<string>, {_LISTS}, confidence double, {_EVIDENCE}, status string, parent_concept_id string, hierarchy_depth long, {_RECALLS}, "
    "connection_count long, lifecycle_scope string, scope_key string, created_at string, updated_at string",
    "concept_relation": "relation_id string, workspace_id string, src string, dst string, relation_type string, lifecycle string, alpha double, beta double, evidence_count long, last_evidence_at string, created_at string, updated_at string",
    "feedback": "feedback_id string, workspace_id string, concept_id string, observation_id string, feedback_type string, feedback_text string, alpha_delta double, beta_delta double, created_at string",
    "timeline": "entry_id string, workspace_id string, entity string, property string, value string, kind string, observation_id string, valid_from string, seq string, created_at string",
    "embedding": "source_type string, source_id string, workspace_id string, text string, vector array<float>, created_at string",
    "concept_alias": "alias_id string, primary_concept_id string, alias_concept_id string, reason string, created_at string",
}
KEYS = {
    "raw_memory": ["memory_id"], "observation": ["observation_id"], "concept_candidate": ["candidate_id"], "concept": ["concept_id"], "concept_relation": ["workspace_id", "src", "dst", "relation_type"],
    "feedback": ["feedback_id"], "timeline": ["entry_id"], "embedding": ["source_type", "source_id"], "concept_alias": ["alias_concept_id"],
}
#: Columns that a version added, with what rows written before it get.
MIGRATIONS = {2: {"observation": {"cross_project_count": "CAST(1 AS BIGINT)", "consolidated": "false"}}, 3: {"concept": {"lifecycle_scope": "'project'", "scope_key": "CAST(NULL AS STRING)"}}}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def shaped(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table in their order and types; missing ones are null, others are left out."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def migrated(df: DataFrame, table: str, version: int) -> DataFrame:
    """Rows of a table written under an older version, with the columns that later ones added."""
    if version > VERSION:
        raise ValueError(f"layout {version} is newer than {VERSION}")
    for v in range(version + 1, VERSION + 1):
        for column, value in MIGRATIONS.get(v, {}).get(table, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.expr(value))
    return shaped(df, table)
