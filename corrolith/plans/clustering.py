"""Registered queries of clustering, merging and splitting, and of structural transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrolith.functions import scalars as S
from corrolith.operators import clusters, graph, transfer, vectors
from corrolith.plans import queries as Q
from corrolith.plans.bridge import frame
from corrolith.plans.registry import query

ITEM, CAND = "b_item", "b_candidate"
#: The given vectors have no clusters; at this distance some of them meet.
HOW = clusters.Clustering(threshold=0.65, merge=0.9)

_COS = "list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))))"
_ENT = "list_distinct(list_filter([trim({0}.subject_text), trim({0}.object_text)], lambda x: x IS NOT NULL AND x <> ''))"
_J = f"(CAST(len(list_intersect({_ENT.format('a')}, {_ENT.format('b')})) AS DOUBLE) / len(list_distinct(list_concat({_ENT.format('a')}, {_ENT.format('b')}))))"
_PAIRS = f", p AS (SELECT a.workspace_id, a.observation_id AS a, b.observation_id AS b, (1 - {_COS}) * (1 - 0.5e0 * {_J}) AS distance FROM b_item a JOIN b_item b ON a.workspace_id = b.workspace_id AND a.observation_id < b.observation_id)"
_LABELS = _PAIRS + """, l AS (SELECT a, b FROM p WHERE distance <= 0.65 UNION SELECT a.observation_id, b.observation_id FROM b_item a JOIN b_item b USING (workspace_id, extraction_batch_id) WHERE a.observation_id < b.observation_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT observation_id AS node, observation_id AS o FROM b_item UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.o), lab AS (SELECT node, min(o) AS label FROM r GROUP BY 1)"""


def _item(spark, sf):
    return frame(spark, sf, ITEM)


def _table(spark, sf):
    items = _item(spark, sf)
    return clusters.cluster_table(items, clusters.clustered(items, HOW))


@query(_PAIRS + " SELECT workspace_id, a, b, round(distance, 6) AS distance FROM p WHERE distance <= 0.65", ITEM)
def combined_pairs(spark, sf):
    return clusters.near_pairs(_item(spark, sf), HOW, entities=True).withColumn("distance", F.round("distance", 6))


@query(_LABELS + " SELECT node AS observation_id, label FROM lab", ITEM)
def observation_clusters(spark, sf):
    return clusters.clustered(_item(spark, sf), HOW)


_TERMS = "list_sort(list_distinct(list_filter(flatten(list([trim(subject_text), trim(object_text)])), lambda x: x IS NOT NULL AND x <> '')))"


@query(_LABELS + f""" SELECT workspace_id, label, {_TERMS}[1] AS name, array_to_string({_TERMS}, ';') AS terms, string_agg(observation_id, ';' ORDER BY observation_id) AS observations, array_to_string(list_sort(list_distinct(list(memory_id))), ';') AS sessions,
count(*) AS evidence_count, round(sum(evidence_alpha) / (sum(evidence_alpha) + sum(evidence_beta)), 6) AS confidence FROM b_item JOIN lab ON node = observation_id GROUP BY 1, 2""", ITEM)
def cluster_candidates(spark, sf):
    made = clusters.candidates(_table(spark, sf).withColumn("__label", F.col("label")))
    label = F.array_min("source_observations")
    return made.select("workspace_id", label.alias("label"), "name", F.array_join("source_terms", ";").alias("terms"), F.array_join("source_observations", ";").alias("observations"), F.array_join("source_sessions", ";").alias("sessions"), "evidence_count", F.round("confidence", 6).alias("confidence"))


@query(_LABELS + """, m AS (SELECT workspace_id, label, count(*) AS size, avg(extraction_confidence * (evidence_alpha / (evidence_alpha + evidence_beta))) AS c FROM b_item JOIN lab ON node = observation_id GROUP BY 1, 2),
d AS (SELECT workspace_id, label, round(sum(x * x), 6) AS square FROM (SELECT workspace_id, label, pos, avg(x) AS x FROM (SELECT workspace_id, label, unnest(range(len(vector))) AS pos, unnest(CAST(vector AS DOUBLE[])) AS x FROM b_item JOIN lab ON node = observation_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT workspace_id, label, size, round(c, 6) AS average_confidence, square FROM m JOIN d USING (workspace_id, label)""", ITEM)
def cluster_centroids(spark, sf):
    square = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    return _table(spark, sf).select("workspace_id", "label", "size", F.round("average_confidence", 6).alias("average_confidence"), F.round(square, 6).alias("square"))


@query(None)
def cluster_entity_merge(spark, sf):
    return clusters.merged_clusters(_table(spark, sf), HOW)


@query("SELECT concat('ws-', vec_id % 5) AS workspace_id, min(len(embedding)) AS low, max(len(embedding)) AS high FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf):
    items = _item(spark, sf)
    clusters.check_dimensions(items)
    return items.groupBy("workspace_id").agg(F.min(F.size("vector")).cast("long").alias("low"), F.max(F.size("vector")).cast("long").alias("high"))


_CT = ", c AS (SELECT *, string_split(terms, ';') AS t FROM b_candidate), jp AS (SELECT a.candidate_id AS a, b.candidate_id AS b FROM c a, c b WHERE a.candidate_id < b.candidate_id AND CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, b.t))) > 0.6)"


@query(_CT + " SELECT a, b FROM jp", CAND)
def candidate_jaccard(spark, sf):
    return clusters.overlapping(frame(spark, sf, CAND))


_UNITE = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list(string_split({c}, ';'))))), ';')"


@query(_CT + f""", e AS (SELECT a, b FROM jp UNION SELECT b, a FROM jp), r AS (SELECT candidate_id AS node, candidate_id AS o FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.o), lab AS (SELECT node, min(o) AS label FROM r GROUP BY 1)
SELECT arg_min(candidate_id, (place, candidate_id)) AS candidate_id, arg_min(name, (place, candidate_id)) AS name, count(*) AS members, CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(list(name))), ';') END AS aliases, {_UNITE('terms')} AS terms, {_UNITE('facts')} AS facts,
CASE WHEN count(*) > 1 THEN CAST(len(list_distinct(flatten(list(string_split(observations, ';'))))) AS BIGINT) ELSE CAST(sum(evidence_count) AS BIGINT) END AS evidence_count, round(sum(evidence_alpha) / (sum(evidence_alpha) + sum(evidence_beta)), 6) AS confidence, CAST(sum(recall_count) AS BIGINT) AS recall_count
FROM c JOIN lab ON node = candidate_id GROUP BY label""", CAND)
def candidate_jaccard_merge(spark, sf):
    out = clusters.merged(frame(spark, sf, CAND))
    return out.select("candidate_id", "name", "members", F.array_join("aliases", ";").alias("aliases"), F.array_join("source_terms", ";").alias("terms"), F.array_join("known_facts", ";").alias("facts"), "evidence_count", F.round("confidence", 6).alias("confidence"), "recall_count")


#: Subclusters of candidates: their observations by a rule.
_PARTS = """, x AS (SELECT candidate_id, unnest(list_distinct(string_split(observations, ';'))) AS observation_id, name, facts, evidence_count, split_part(name, ' ', 1) AS w1, split_part(name, ' ', 2) AS w2 FROM b_candidate),
p AS (SELECT candidate_id, name, facts, evidence_count, observation_id, CASE WHEN ends_with(observation_id, concat('-', split_part(candidate_id, '-', 2))) THEN 'own' ELSE 'other' END AS part, CASE WHEN ends_with(observation_id, concat('-', split_part(candidate_id, '-', 2))) THEN w1 ELSE w2 END AS subject_text FROM x),
g AS (SELECT candidate_id, part, any_value(name) AS parent, any_value(facts) AS facts, any_value(evidence_count) AS broad, string_agg(observation_id, ';' ORDER BY observation_id) AS observations, count(*) AS n, min(subject_text) AS term FROM p GROUP BY 1, 2),
k AS (SELECT candidate_id FROM g WHERE broad >= 4 GROUP BY 1 HAVING count(*) >= 2)"""


@query(_PARTS + """ SELECT candidate_id, part, term AS name, observations, array_to_string(list_sort(list_filter(string_split(facts, ';'), lambda f: contains(f, term))), ';') AS facts, n AS evidence_count, 0.5e0 AS confidence FROM g WHERE candidate_id IN (SELECT candidate_id FROM k)
UNION ALL SELECT candidate_id, NULL, name, observations, facts, evidence_count, round(evidence_alpha / (evidence_alpha + evidence_beta), 6) FROM b_candidate WHERE candidate_id NOT IN (SELECT candidate_id FROM k)""", CAND)
def candidate_split(spark, sf):
    rows = frame(spark, sf, CAND)
    each = rows.select("candidate_id", "name", F.explode(F.array_distinct("source_observations")).alias("observation_id"))
    own = F.endswith("observation_id", F.concat(F.lit("-"), F.split_part("candidate_id", F.lit("-"), F.lit(2))))
    parts = each.select("candidate_id", F.when(own, "own").otherwise("other").alias("part"), "observation_id", F.when(own, F.split_part("name", F.lit(" "), F.lit(1))).otherwise(F.split_part("name", F.lit(" "), F.lit(2))).alias("subject_text"), F.lit(None).cast("string").alias("object_text"), F.lit("m").alias("memory_id"), F.lit(1.0).alias("evidence_alpha"), F.lit(1.0).alias("evidence_beta"))
    rows = rows.withColumn("confidence", clusters.confidence(F.col("evidence_alpha"), F.col("evidence_beta"))).withColumn("evidence_count", F.col("evidence_count").cast("long"))
    out = clusters.split(rows, parts)
    return out.select("candidate_id", "part", "name", F.array_join("source_observations", ";").alias("observations"), F.array_join("known_facts", ";").alias("facts"), "evidence_count", F.round("confidence", 6).alias("confidence"))


# ---- structural transfer ----


def _bag(spark, sf):
    """Nodes, half edges and bags of the representatives of like concepts, and who is like them. All are read several times."""
    nodes, members = transfer.representatives_of(vectors.stored(transfer.entity_sets(Q._con(spark, sf))))
    nodes = vectors.stored(nodes)
    halves = transfer.half_edges(nodes, frame(spark, sf, "b_cause", large=True), None)
    return nodes, halves, vectors.stored(transfer.bags(transfer.labels(nodes, halves))), members


def _round(before: str, after: str) -> str:
    """One round of labels."""
    return f""", {after} AS (SELECT n.concept_id, n.node, md5(concat(n.label, '#', coalesce(near, ''))) AS label FROM {before} n LEFT JOIN (
  SELECT concept_id, node, string_agg(concat(side, ':causes>', seen, '*', times), ',' ORDER BY concat(side, ':causes>', seen, '*', times)) AS near FROM (
    SELECT h.concept_id, h.node, side, coalesce(l.label, other) AS seen, sum(times) AS times FROM h LEFT JOIN {before} l ON l.concept_id = h.concept_id AND l.node = h.other GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) USING (concept_id, node))"""


_WL = """, n AS (SELECT DISTINCT concept_id, workspace_id, status, lifecycle_scope, lower(e) AS node FROM (SELECT *, unnest([narrow, entity_1, entity_2, entity_3]) AS e FROM b_concept)), cw AS (SELECT workspace_id, subject_text AS s, object_text AS o, count(*) AS times FROM b_cause GROUP BY ALL),
h AS (SELECT concept_id, node, 'o' AS side, o AS other, times FROM n JOIN cw ON cw.workspace_id = n.workspace_id AND s = node UNION ALL SELECT concept_id, node, 'i', s, times FROM n JOIN cw ON cw.workspace_id = n.workspace_id AND o = node),
d AS (SELECT concept_id, node, sum(CASE side WHEN 'o' THEN times ELSE 0 END) AS n_out, sum(CASE side WHEN 'i' THEN times ELSE 0 END) AS n_in FROM h GROUP BY 1, 2),
l0 AS (SELECT concept_id, node, concat('d', coalesce(n_out, 0) + coalesce(n_in, 0), CASE WHEN n_in > 0 THEN concat('|in:causes:', n_in) ELSE '' END, CASE WHEN n_out > 0 THEN concat('|out:causes:', n_out) ELSE '' END) AS label FROM n LEFT JOIN d USING (concept_id, node))""" + _round("l0", "l1") + _round("l1", "l2") + ", bag AS (SELECT concept_id, label, count(*) AS count FROM l2 GROUP BY 1, 2)"


@query(_WL + " SELECT concept_id, label, count FROM bag", "b_concept", "b_cause")
def wl_fingerprint(spark, sf):
    _, _, bag, members = _bag(spark, sf)
    return transfer.for_members(bag, members)


@query(_WL + """, e AS (SELECT concept_id, sum(CASE WHEN side = 'i' AND EXISTS (SELECT 1 FROM n WHERE n.concept_id = h.concept_id AND n.node = h.other) THEN 0 ELSE times END) AS e FROM h GROUP BY 1),
k AS (SELECT concept_id, count(*) AS k FROM n GROUP BY 1), b AS (SELECT concept_id, string_agg(concat(label, ':', count), ';' ORDER BY concat(label, ':', count)) AS b FROM bag GROUP BY 1)
SELECT concept_id, concat('n', k, '|e', coalesce(e, 0), '|', b) AS fingerprint FROM k JOIN b USING (concept_id) LEFT JOIN e USING (concept_id)""", "b_concept", "b_cause")
def fingerprint_text(spark, sf):
    nodes, halves, bag, members = _bag(spark, sf)
    return transfer.for_members(transfer.fingerprints(nodes, halves, bag), members)


_TARGET = "(SELECT min(concept_id) FROM n WHERE workspace_id = 'ws-1')"
_PEERS = _WL + f""", own AS (SELECT label, count AS mine FROM bag WHERE concept_id = {_TARGET}), size AS (SELECT concept_id, sqrt(sum(count * count)) AS size FROM bag GROUP BY 1),
dot AS (SELECT concept_id, sum(count * mine) AS dot FROM bag JOIN own USING (label) GROUP BY 1),
peers AS (SELECT concept_id, workspace_id, dot / (size * (SELECT size FROM size WHERE concept_id = {_TARGET})) AS similarity FROM (SELECT DISTINCT concept_id, workspace_id FROM n WHERE workspace_id <> 'ws-1' AND (status = 'active' OR lifecycle_scope = 'global')) JOIN size USING (concept_id) JOIN dot USING (concept_id) WHERE similarity >= 0.85)"""


def _peers(spark, sf):
    con = Q._con(spark, sf)
    target = con.filter("workspace_id = 'ws-1'").agg(F.min("concept_id")).first()[0]
    _, _, bag, members = _bag(spark, sf)
    return transfer.structural_peers(con, bag, target, "ws-1", members=members)


@query(_PEERS + " SELECT concept_id, workspace_id, round(similarity, 6) AS similarity FROM peers", "b_concept", "b_cause")
def structural_peers(spark, sf):
    return _peers(spark, sf).withColumn("similarity", F.round("similarity", 6))


_CAUSAL = Q._CAUSES.replace("b_cause o", "b_cause_timed o").replace(" AS evidence\n", " AS evidence, created_ts, observation_id\n")
_EDGES = _PEERS + _CAUSAL + ", t AS (" + Q._fold_ordered("ca", "created_ts DESC, observation_id, evidence") + "), te AS (SELECT p.concept_id AS peer_id, p.workspace_id, similarity, src, dst, relation_type, weight, lifecycle FROM peers p JOIN t ON t.src = p.concept_id OR t.dst = p.concept_id WHERE lifecycle IN ('validated', 'confirmed'))"


def _edges(spark, sf, peers):
    edges = graph.causes_edges(Q._narrow(spark, sf), frame(spark, sf, "b_cause_timed"), Q.newest(), peers.select("concept_id"), transfer.GOOD)
    return transfer.transfer_edges(peers, edges)


@query(_EDGES + " SELECT peer_id, workspace_id, src, dst, weight, lifecycle FROM te", "b_concept", "b_cause", "b_cause_timed")
def transfer_edges(spark, sf):
    peers = vectors.checkpointed(_peers(spark, sf))
    edges = graph.causes_edges_of(Q._narrow(spark, sf), frame(spark, sf, "b_cause_timed"), Q.newest(), peers, transfer.GOOD, Q.DIGITS)
    return edges.select(F.col("concept_id").alias("peer_id"), "workspace_id", "src", "dst", "weight", "lifecycle")


@query(_EDGES + """, few AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY src, dst, relation_type) AS nth FROM te QUALIFY nth <= 3), first AS (SELECT concept_id, workspace_id, similarity FROM peers ORDER BY similarity DESC, concept_id LIMIT 12)
SELECT CAST(row_number() OVER (ORDER BY f.similarity DESC, concept_id, nth NULLS FIRST) AS INT) AS place, CASE WHEN src IS NULL THEN printf('[%s] 结构相似度 %.2f，但无已验证因果边可迁移', f.workspace_id, f.similarity)
  ELSE printf('[%s · sim %.2f] 因果边 %s → %s（%s，weight %.2f）', f.workspace_id, f.similarity, src, dst, concat(upper(lifecycle[1]), lifecycle[2:]), weight) END AS note FROM first f LEFT JOIN few ON peer_id = concept_id QUALIFY place <= 12""", "b_concept", "b_cause", "b_cause_timed")
def transfer_notes(spark, sf):
    peers = vectors.checkpointed(_peers(spark, sf))
    return transfer.transfer_notes(peers, _edges(spark, sf, transfer.first_peers(peers)))


@query(" SELECT concept_id, workspace_id FROM b_concept WHERE workspace_id <> 'ws-1' AND status = 'active'", "b_concept")
def other_workspace_concepts(spark, sf):
    return transfer.visible_peers(Q._con(spark, sf), "ws-1").select("concept_id", "workspace_id")


@query(" SELECT concept_id, workspace_id FROM b_concept WHERE workspace_id <> 'ws-1' AND (status = 'active' OR lifecycle_scope = 'global')", "b_concept")
def foreign_concepts(spark, sf):
    return transfer.foreign(Q._con(spark, sf), "ws-1").select("concept_id", "workspace_id")


@query(" SELECT a.observation_id AS a, b.observation_id AS b, round(" + _J + ", 6) AS overlap FROM b_item a JOIN b_item b ON a.workspace_id = b.workspace_id AND a.memory_id = b.memory_id AND a.observation_id < b.observation_id", ITEM)
def entity_jaccard(spark, sf):
    items = _item(spark, sf).select("workspace_id", "memory_id", "observation_id", S.entity_set(F.col("subject_text"), F.col("object_text")).alias("e"))
    p, q = items.withColumnsRenamed({"observation_id": "a", "e": "ea"}), items.withColumnsRenamed({"observation_id": "b", "e": "eb"})
    return p.join(q, ["workspace_id", "memory_id"]).filter("a < b").select("a", "b", F.round(S.jaccard(F.col("ea"), F.col("eb")), 6).alias("overlap"))
