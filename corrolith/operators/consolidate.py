"""Offline consolidation of a store: maintenance of the ledger, then linking of concepts, then promotion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.operators import graph, ledger


@dataclass
class Consolidated:
    """The tables after a run, and the report by workspace."""

    observations: DataFrame
    edges: DataFrame
    concepts: DataFrame
    aliases: DataFrame
    report: DataFrame


def consolidate(concepts: DataFrame, obs: DataFrame, domain_key: str | None = None, order: list | None = None) -> Consolidated:
    """Maintenance of obs; evidence for edges between concepts from what is live afterwards; promotion of project concepts by
    the workspaces in which what they are about is live, and one alias for each promoted concept."""
    state = ledger.maintained(obs)
    after = ledger.after_maintenance(obs)
    edges = graph.link_edges(concepts, concepts, after, after, ["phase", *(order or [F.desc("created_ts"), "observation_id", "evidence"])])
    counted = concepts.join(graph.related_counts(concepts, after), "concept_id").withColumn("conflict_count", F.lit(0))
    done = graph.promoted(graph.promotion(counted), domain_key)
    project = concepts.filter("lifecycle_scope = 'project'").select("concept_id")
    told = done.join(project, "concept_id", "left_semi")
    links = graph.promotion_aliases(told, concepts)
    new = told.filter("changed").select("concept_id", F.col("lifecycle_scope").alias("__scope"), F.col("scope_key").alias("__key"))
    kept = concepts.join(new, "concept_id", "left").withColumns({"scope_key": F.when(F.col("__scope").isNotNull(), F.col("__key")).otherwise(F.col("scope_key")), "lifecycle_scope": F.coalesce("__scope", "lifecycle_scope")}).drop("__scope", "__key")
    report = ledger.maintenance_report(state)
    promoted = told.filter("reported IS NOT NULL").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    for more, name in ((graph.shared_entity_count(concepts), "shared_entity_evidence"), (graph.batch_count(concepts, after), "coclaim_evidence"), (graph.causes_count(concepts, after), "causal_evidence"), (promoted, "promoted")):
        report = report.join(more.withColumnRenamed("n", name), "workspace_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return Consolidated(after, edges, graph.with_aliases(kept, links), links, report)
