"""Registered queries of seed bundles and of whole consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith.operators import consolidate as whole
from corrolith.plans import queries as Q
from corrolith.plans import relational as R
from corrolith.plans.bridge import frame
from corrolith.plans.registry import query
from corrolith.sources import bundles

NOW = "2026-01-01T00:00:00Z"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle for each brand: its parts as concepts, what they are as observations, and relations between neighbours."""
    c = F.col
    source = F.when(c("p_partkey") % 3 == 0, F.lit(None)).when(c("p_partkey") % 3 == 1, "user_confirm").otherwise("assistant_guess")
    obs = F.struct(c("p_partkey").cast("string").alias("id"), F.col("p_name").alias("subject"), F.lit("has").alias("predicate"), F.when(c("p_size") % 2 == 0, F.lower("p_type")).alias("object"), F.concat(F.lit("seen "), "p_name").alias("evidence"), F.when(c("p_size") % 4 > 0, F.concat(F.lit("ws-"), c("p_partkey") % 5)).alias("workspace"), source.alias("source"))
    con = F.struct(F.concat(F.lit("c-"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("entities"), F.when(c("p_size") % 5 == 0, "global").when(c("p_size") % 5 == 1, "odd").alias("lifecycle_scope"))
    rel = F.struct(F.concat(F.lit("c-"), c("p_partkey") + c("p_size") % 3).alias("src"), F.concat(F.lit("c-"), "p_partkey").alias("dst"), F.when(c("p_size") % 7 == 0, "temporal").when(c("p_size") % 7 == 1, "shared_session").alias("relation_type"))
    parts = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").agg(F.collect_list(obs).alias("observations"), F.collect_list(con).alias("concepts"), F.collect_list(rel).alias("relations"))
    return parts.select(F.col("p_brand").alias("source_ref"), F.to_json(F.struct("observations", "concepts", "relations")).alias("content"))


def _added(spark, sf):
    con = Q._con(spark, sf).filter("status = 'active'").select("concept_id")
    none = lambda *c: spark.createDataFrame([], ", ".join(f"{x} string" for x in c))
    stored = {"raw_memory": none("memory_id"), "observation": none("observation_id"), "concept": con, "concept_relation": none("workspace_id", "src", "dst", "relation_type")}
    return bundles.applied(bundles.parsed(_files(spark, sf)), stored, NOW)


@query("SELECT concat('obs-', p_partkey) AS observation_id, CASE WHEN p_size % 4 > 0 THEN concat('ws-', p_partkey % 5) ELSE 'default' END AS workspace_id, p_name AS subject_text, CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS object_text, CASE p_partkey % 3 WHEN 0 THEN 'file_evidence' WHEN 1 THEN 'user_confirm' ELSE 'assistant_guess' END AS source_type, CASE p_partkey % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 4.5e0 ELSE 2.5e0 END AS evidence_alpha, 1e0 AS evidence_beta, CASE p_partkey % 3 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.85e0 ELSE 0.3e0 END AS extraction_confidence FROM part")
def seed_observations(spark, sf):
    return _added(spark, sf)["observation"].select("observation_id", "workspace_id", "subject_text", "object_text", "source_type", "evidence_alpha", "evidence_beta", "extraction_confidence")


@query(" SELECT concat('c-', p_partkey) AS concept_id, p_name AS name, split_part(p_name, ' ', 1) AS entities, CASE p_size % 5 WHEN 0 THEN 'global' ELSE 'project' END AS lifecycle_scope, 0.85e0 AS confidence, 5e0 AS evidence_alpha FROM part WHERE concat('c-', p_partkey) NOT IN (SELECT concept_id FROM b_concept WHERE status = 'active')", Q.CON)
def seed_concepts(spark, sf):
    return _added(spark, sf)["concept"].select("concept_id", "name", F.array_join("related_entities", ";").alias("entities"), "lifecycle_scope", "confidence", "evidence_alpha")


@query("SELECT CASE WHEN k = 'temporal' OR a < b THEN a ELSE b END AS src, CASE WHEN k = 'temporal' OR a < b THEN b ELSE a END AS dst, k AS relation_type, 2e0 AS alpha, round(2 / 3e0, 6) AS weight FROM (SELECT DISTINCT concat('c-', p_partkey + p_size % 3) AS a, concat('c-', p_partkey) AS b, CASE p_size % 7 WHEN 0 THEN 'temporal' WHEN 1 THEN 'shared_session' ELSE 'shared_entity' END AS k FROM part WHERE p_size % 3 > 0)")
def seed_relations(spark, sf):
    return _added(spark, sf)["concept_relation"].select("src", "dst", "relation_type", "alpha", F.round("weight", 6).alias("weight"))


#: Concepts that the observations name: by their name, brand and both.
_NAMED = ", nc AS (SELECT *, [replace(name, ' ', '_'), entity_3, narrow] AS ents FROM b_concept)"
_AFTER = R._DREAM + _NAMED + f""", al AS (SELECT b.* REPLACE (coalesce(s.new_status, b.status) AS status) FROM b_observation b LEFT JOIN s ON s.observation_id = b.observation_id), live AS (SELECT * FROM al WHERE {R.STRICT}),
ix AS (SELECT workspace_id, concept_id, unnest(list_distinct(ents)) AS entity FROM nc WHERE status = 'active'), rare AS (SELECT workspace_id, entity FROM ix GROUP BY ALL HAVING count(*) <= 8),
e0 AS (SELECT workspace_id, count(*) AS n FROM ix a JOIN ix b USING (workspace_id, entity) JOIN rare USING (workspace_id, entity) WHERE a.concept_id < b.concept_id GROUP BY 1),
m AS (SELECT DISTINCT live.workspace_id, extraction_batch_id, concept_id FROM live JOIN ix ON live.workspace_id = ix.workspace_id AND subject_text = entity), e1 AS (SELECT workspace_id, count(*) AS n FROM m a JOIN m b USING (workspace_id, extraction_batch_id) WHERE a.concept_id < b.concept_id GROUP BY 1),
e2 AS (SELECT l.workspace_id, count(*) AS n FROM live l JOIN ix a ON a.workspace_id = l.workspace_id AND a.entity = subject_text JOIN ix b ON b.workspace_id = l.workspace_id AND b.entity = object_text WHERE predicate = 'causes' AND a.concept_id <> b.concept_id GROUP BY 1),
tri AS (SELECT subject_text, predicate, object_text, count(DISTINCT workspace_id) AS n FROM al WHERE {R.LIVE} GROUP BY 1, 2, 3), said AS (SELECT DISTINCT o.workspace_id, o.subject_text, o.object_text, n FROM al o JOIN tri t ON o.subject_text = t.subject_text AND o.predicate = t.predicate AND o.object_text IS NOT DISTINCT FROM t.object_text),
ent AS (SELECT workspace_id, entity, max(n) AS n FROM (SELECT workspace_id, subject_text AS entity, n FROM said UNION ALL SELECT workspace_id, object_text, n FROM said) WHERE entity IS NOT NULL GROUP BY 1, 2),
cc AS (SELECT concept_id, greatest(coalesce(max(n), 1), 1) AS x FROM (SELECT concept_id, workspace_id, unnest(ents) AS entity FROM nc) LEFT JOIN ent USING (workspace_id, entity) GROUP BY 1),
pr AS (SELECT workspace_id, count(*) AS n FROM nc JOIN cc USING (concept_id) WHERE lifecycle_scope = 'project' AND ((x >= 3 AND confidence >= 0.85 AND {Q._SESSIONS} >= 3) OR (x >= 2 AND confidence >= 0.75 AND {Q._SESSIONS} >= 2)) GROUP BY 1)
SELECT workspace_id, count(*) FILTER (new_status = 'superseded') AS merged, count(*) FILTER (new_status <> 'superseded' AND hit) AS softened, count(*) FILTER (new_status = 'deprecated') AS archived, count(*) AS consolidated,
  coalesce(any_value(e0.n), 0) AS shared_entity_evidence, coalesce(any_value(e1.n), 0) AS coclaim_evidence, coalesce(any_value(e2.n), 0) AS causal_evidence, coalesce(any_value(pr.n), 0) AS promoted FROM s LEFT JOIN e0 USING (workspace_id) LEFT JOIN e1 USING (workspace_id) LEFT JOIN e2 USING (workspace_id) LEFT JOIN pr USING (workspace_id) GROUP BY 1"""


def _consolidated(spark, sf):
    con = Q._con(spark, sf)
    named = con.withColumn("related_entities", F.array(F.replace("name", F.lit(" "), F.lit("_")), "entity_3", "narrow"))
    return whole.consolidate(named, frame(spark, sf, Q.OBS), "parts")


@query(_AFTER, Q.OBS, Q.CON)
def consolidate(spark, sf):
    return _consolidated(spark, sf).report
