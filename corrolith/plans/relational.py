"""Registered queries of the relational layer: listings, writes as snapshots, timeline, feedback, promotion and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import graph, history, ledger, store
from corrolith.plans import queries as Q
from corrolith.plans.bridge import frame
from corrolith.plans.registry import listed, query

LIVE, STRICT, OBS, CON, FB, TL, EMB, MOD = Q.LIVE, Q.STRICT, Q.OBS, Q.CON, Q.FB, Q.TL, Q.EMB, "b_module"


def _mod(spark, sf):
    return frame(spark, sf, MOD)


# ---- listings ----


@query(" SELECT concept_id, name, created_at FROM b_module WHERE workspace_id = 'ws-1' AND status = 'active'", MOD)
def concepts_by_status(spark, sf):
    rows = _mod(spark, sf).filter("workspace_id = 'ws-1' AND status = 'active'")
    return store.listing_order(rows, F.desc("created_at"), "concept_id").select("concept_id", "name", "created_at")


@query(" SELECT candidate_id, name FROM b_candidate WHERE workspace_id = 'ws-1'", "b_candidate")
def candidates_by_workspace(spark, sf):
    return frame(spark, sf, "b_candidate").filter("workspace_id = 'ws-1'").select("candidate_id", "name")


@query(" SELECT observation_id FROM b_observation WHERE workspace_id = 'ws-1' AND status = 'confirmed' ORDER BY created_ts DESC, observation_id LIMIT 100", OBS)
def newest_observations(spark, sf):
    rows = ledger.by_status(frame(spark, sf, OBS), "ws-1", "confirmed")
    return store.listing_order(rows, F.desc("created_ts"), "observation_id").limit(100).select("observation_id")


@query(f" SELECT observation_id, workspace_id FROM b_observation WHERE {LIVE} AND subject_text = 'red_bolt' AND predicate = 'has' AND object_text IS NULL", OBS)
def duplicates_any_workspace(spark, sf):
    rows = ledger.of_triple(frame(spark, sf, OBS), "red_bolt", "has", None)
    return store.listing_order(rows, "workspace_id", "created_ts").select("observation_id", "workspace_id")


@query(" SELECT concept_id, name, status FROM b_module WHERE concept_id = 'c-7'", MOD)
def point_lookup(spark, sf):
    return store.get(_mod(spark, sf), "concept_id", "c-7").select("concept_id", "name", "status")


@query(" SELECT event_id, feedback_text FROM b_feedback_events WHERE concept_id = 'c-7'", FB)
def feedback_history(spark, sf):
    rows = frame(spark, sf, FB).filter("concept_id = 'c-7'")
    return store.listing_order(rows, "ts", "event_id").select("event_id", "feedback_text")


@query(Q._SHARED + Q._fold("sh").replace("FROM sh GROUP BY", "FROM (SELECT * FROM sh WHERE workspace_id = 'ws-1') GROUP BY"), CON)
def workspace_edges(spark, sf):
    edges = graph.fold_edges(graph.shared_entity_events(Q._con(spark, sf)))
    return Q._edges(store.edges_of(edges, "ws-1"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT concat('c-', l_partkey) AS alias_id, concat('c-', l_partkey // 2) AS primary_id FROM lineitem),
r AS (SELECT alias_id AS concept_id, primary_id AS node, 1 AS hops FROM l UNION ALL SELECT r.concept_id, l.primary_id, hops + 1 FROM r JOIN l ON r.node = l.alias_id WHERE hops < 8 AND l.alias_id <> l.primary_id)
SELECT concept_id, arg_max(node, hops) AS resolved_id FROM r GROUP BY 1""")
def alias_resolve(spark, sf):
    part = F.col("l_partkey")
    links = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("c-"), part).alias("alias_concept_id"), F.concat(F.lit("c-"), F.floor(part / 2)).alias("primary_concept_id")).distinct()
    return graph.aliases(links)


# ---- writes ----


@query(" SELECT source_type, source_id, workspace_id, label FROM (SELECT * FROM b_embedding WHERE label % 2 = 1 UNION ALL SELECT source_type, source_id, 'moved', vector, label FROM b_embedding WHERE label % 2 = 0) WHERE label <> 4", EMB)
def embedding_upsert(spark, sf):
    stored = frame(spark, sf, EMB)
    key = ["source_type", "source_id"]
    after = store.upsert(stored.filter("label % 2 = 0").withColumn("workspace_id", F.lit("moved")), stored, key, ["label"])
    return store.delete(after, stored.filter("label = 4"), key).select("source_type", "source_id", "workspace_id", "label")


@query(f", f AS (SELECT *, {Q._PERSIST} AS persistence, {Q._TYPE} AS feedback_type FROM b_feedback_events) SELECT event_id, concept_id, feedback_type, {Q._FD[0]} AS alpha_delta, {Q._FD[1]} AS beta_delta FROM f WHERE persistence <> 'task_temporary'", FB)
def feedback_ledger(spark, sf):
    rows = history.ledger(frame(spark, sf, FB)).select("event_id", "concept_id", "feedback_type", "alpha_delta", "beta_delta")
    return store.append_strict(rows, rows.limit(0), "event_id")


@query(" SELECT observation_id, CASE status WHEN 'disputed' THEN 'confirmed' ELSE status END AS status, CASE status WHEN 'disputed' THEN evidence_alpha + 2 ELSE evidence_alpha END AS evidence_alpha FROM b_observation", OBS)
def observation_updates(spark, sf):
    obs = frame(spark, sf, OBS)
    told = obs.filter("status = 'disputed'").select("observation_id", F.lit("confirmed").alias("status"), (F.col("evidence_alpha") + 2).alias("evidence_alpha"))
    return store.update(obs, told, "observation_id", ["status", "evidence_alpha"]).select("observation_id", "status", "evidence_alpha")


@query(" SELECT concept_id, recall_count + coalesce(n, 0) AS recall_count, coalesce(substr(CAST(ts AS VARCHAR), 1, 19), last_recalled_at) AS last_recalled_at FROM b_module LEFT JOIN (SELECT concat('c-', user_id) AS concept_id, count(*) AS n, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1) USING (concept_id)", MOD)
def record_recalls(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'view'").select(F.concat(F.lit("c-"), "user_id").alias("concept_id"), F.substring(F.col("ts").cast("string"), 1, 19).alias("at"))
    return store.record_recalls(_mod(spark, sf), events).select("concept_id", F.col("recall_count").cast("long").alias("recall_count"), "last_recalled_at")


@query(" SELECT concept_id, successful_recall_count + coalesce(good, 0) AS successful, coalesce(bad, 0) AS failed FROM b_module LEFT JOIN (SELECT concat('c-', user_id) AS concept_id, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type = 'error') AS bad FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) USING (concept_id)", MOD)
def record_outcomes(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_type IN ('purchase', 'error')").select(F.concat(F.lit("c-"), "user_id").alias("concept_id"), (F.col("event_type") == "purchase").alias("success"))
    out = store.record_outcomes(_mod(spark, sf).withColumn("failed_recall_count", F.lit(0).cast("long")), events)
    return out.select("concept_id", F.col("successful_recall_count").cast("long").alias("successful"), F.col("failed_recall_count").alias("failed"))


@query(" SELECT DISTINCT CASE WHEN l_linenumber = 7 OR p < q THEN p ELSE q END AS src, CASE WHEN l_linenumber = 7 OR p < q THEN q ELSE p END AS dst, CASE l_linenumber WHEN 7 THEN 'temporal' ELSE 'shared_session' END AS relation_type, 1e0 AS alpha, 1e0 AS beta, CAST(0 AS BIGINT) AS evidence_count, 'candidate' AS lifecycle FROM (SELECT concat('c-', l_partkey) AS p, concat('c-', l_suppkey) AS q, l_linenumber FROM lineitem WHERE l_partkey <> l_suppkey)")
def edge_start(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_partkey <> l_suppkey")
    kind = F.when(F.col("l_linenumber") == 7, "temporal").otherwise("shared_session")
    pairs = lines.select(F.lit("ws").alias("workspace_id"), F.concat(F.lit("c-"), "l_partkey").alias("a"), F.concat(F.lit("c-"), "l_suppkey").alias("b"), kind.alias("relation_type"))
    return store.new_edges(pairs, "2026-01-01").select("src", "dst", "relation_type", "alpha", "beta", "evidence_count", "lifecycle")


@query(Q._SHARED + ", e AS (SELECT DISTINCT src, dst FROM sh) SELECT concept_id, connection_count + coalesce(n, 0) AS connection_count FROM b_concept LEFT JOIN (SELECT c AS concept_id, count(*) AS n FROM (SELECT src AS c FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) USING (concept_id)", CON)
def connection_counts(spark, sf):
    con = Q._con(spark, sf)
    edges = graph.fold_edges(graph.shared_entity_events(con))
    return store.with_connections(con, edges.limit(0), edges).select("concept_id", F.col("connection_count").cast("long").alias("connection_count"))


@query(Q._SHARED + f""", e AS (SELECT DISTINCT src, dst FROM sh), v AS (SELECT 'edge.src' AS reference, src AS value FROM e WHERE src NOT IN (SELECT concept_id FROM b_concept) UNION SELECT 'edge.dst', dst FROM e WHERE dst NOT IN (SELECT concept_id FROM b_concept)
UNION SELECT 'feedback.concept', concept_id FROM b_feedback_events WHERE concept_id NOT IN (SELECT concept_id FROM b_concept WHERE status = 'active') UNION SELECT 'observation.memory', memory_id FROM b_observation WHERE memory_id NOT IN (SELECT memory_id FROM b_order_memory WHERE content = 'F')) SELECT reference, value FROM v""", CON, FB, OBS, "b_order_memory")
def reference_violations(spark, sf):
    con = Q._con(spark, sf)
    edges = graph.fold_edges(graph.shared_entity_events(con))
    told = store.reference_violations(edges, con, frame(spark, sf, FB).limit(0), frame(spark, sf, OBS), frame(spark, sf, "b_order_memory").filter("content = 'F'"))
    # only active concepts take feedback here, so that some references have no target
    return told.union(store.reference_violations(edges.limit(0), con.filter("status = 'active'"), frame(spark, sf, FB), frame(spark, sf, OBS).limit(0), frame(spark, sf, "b_order_memory").limit(0)))


# ---- timeline ----

_EVENTS = ", ev AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'expire' ELSE 'append' END AS kind FROM b_timeline_events), vx AS (SELECT *, lead(valid_from) OVER w AS valid_to, lead(kind) OVER w AS next_kind, lead(seq) OVER w AS next_seq FROM ev WINDOW w AS (PARTITION BY workspace_id, entity, property ORDER BY valid_from, seq))"


def _versions(spark, sf):
    events = frame(spark, sf, TL).withColumn("kind", F.when(F.col("seq") % 4 == 0, "expire").otherwise("append"))
    return history.versions_with_expiry(events)


@query(_EVENTS + " SELECT seq, entity, property, value, substr(CAST(valid_to AS VARCHAR), 1, 19) AS valid_to, CASE WHEN next_kind = 'append' THEN next_seq END AS superseded_by, CASE WHEN next_kind IS NULL THEN 'active' WHEN next_kind = 'expire' THEN 'expired' ELSE 'superseded' END AS status FROM vx WHERE kind = 'append'", TL)
def timeline_expiry(spark, sf):
    return _versions(spark, sf).select("seq", "entity", "property", "value", F.substring(F.col("valid_to").cast("string"), 1, 19).alias("valid_to"), "superseded_by", "status")


@query(_EVENTS + " SELECT seq, property, value FROM vx WHERE kind = 'append' AND workspace_id = 'ws-1' AND entity = 'cust-1'", TL)
def timeline_of_entity(spark, sf):
    rows = history.history_of(_versions(spark, sf), "ws-1", "cust-1")
    return store.listing_order(rows, "property", F.desc("valid_from")).select("seq", "property", "value")


@query(_EVENTS + " SELECT seq, concat(CASE WHEN next_kind IS NULL THEN '●' ELSE '○' END, ' ', property, '=', coalesce(value, '?'), ' (', substr(CAST(valid_from AS VARCHAR), 1, 10), ' → ', coalesce(substr(CAST(valid_to AS VARCHAR), 1, 10), 'now'), ')') AS line FROM vx WHERE kind = 'append'", TL)
def timeline_lines(spark, sf):
    day = lambda c: F.substring(F.col(c).cast("string"), 1, 10)
    rows = _versions(spark, sf)
    return history.history_lines(rows.withColumns({"valid_from": day("valid_from"), "valid_to": day("valid_to")})).select("seq", "line")


@query(" SELECT workspace_id, entity, property, value, observation_id, status FROM (SELECT workspace_id, subject_text AS entity, predicate AS property, object_text AS value, observation_id, CASE WHEN lead(observation_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM b_observation WINDOW w AS (PARTITION BY workspace_id, subject_text, predicate ORDER BY created_ts, observation_id))", OBS)
def timeline_from_observations(spark, sf):
    events = history.from_observations(frame(spark, sf, OBS), F.col("created_ts"))
    return history.versions(events).select("workspace_id", "entity", "property", "value", "observation_id", "status")


@query(" SELECT workspace_id, count(*) AS n_entries, count(DISTINCT entity) AS n_entities FROM b_timeline_events GROUP BY 1", TL)
def timeline_counts(spark, sf):
    return frame(spark, sf, TL).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("entity").alias("n_entities"))


# ---- feedback ----

_KEPT = f", f AS (SELECT *, {Q._PERSIST} AS persistence, {Q._TYPE} AS feedback_type FROM b_feedback_events), k AS (SELECT concept_id, feedback_type, feedback_text, min((ts, event_id)) AS first FROM f WHERE persistence <> 'task_temporary' GROUP BY 1, 2, 3)"


def _join_texts(kind: str) -> str:
    return f"(SELECT concept_id, string_agg(feedback_text, ';' ORDER BY first) AS {kind}_texts FROM k WHERE feedback_type = '{kind}' GROUP BY 1)"


@query(_KEPT + f""", r AS (SELECT concept_id, evidence_alpha + sum({Q._FD[0]}) OVER w AS a, evidence_beta + sum({Q._FD[1]}) OVER w AS b FROM f JOIN b_module USING (concept_id) WHERE persistence <> 'task_temporary' WINDOW w AS (PARTITION BY concept_id ORDER BY ts, event_id)),
g AS (SELECT concept_id, max(a) AS a, max(b) AS b, bool_or(a / (a + b) < 0.4) AS low FROM r GROUP BY 1)
SELECT m.concept_id, round(CASE WHEN a IS NULL THEN confidence ELSE a / (a + b) END, 6) AS confidence, CASE WHEN low AND status IN ('active', 'labile') THEN 'deprecated' ELSE status END AS status, coalesce(concept_type, CASE WHEN preference_texts IS NOT NULL THEN 'preference' END) AS concept_type,
concat_ws(';', array_to_string(from_json(rejected_json, '["VARCHAR"]'), ';'), negate_texts) AS rejected, concat_ws(';', array_to_string(from_json(facts_json, '["VARCHAR"]'), ';'), preference_texts) AS facts,
concat_ws(';', array_to_string(from_json(entities_json, '["VARCHAR"]'), ';'), CASE WHEN supplement_texts IS NOT NULL THEN 'see;index' END) AS entities
FROM b_module m LEFT JOIN g USING (concept_id) LEFT JOIN {_join_texts('negate')} USING (concept_id) LEFT JOIN {_join_texts('preference')} USING (concept_id) LEFT JOIN {_join_texts('supplement')} USING (concept_id)""", FB, MOD)
def feedback_revisions(spark, sf):
    out = history.revised(frame(spark, sf, FB), _mod(spark, sf), None)
    join = lambda c: F.array_join(c, ";")
    return out.select("concept_id", F.round("confidence", 6).alias("confidence"), "status", "concept_type", join("rejected_hypotheses").alias("rejected"), join("known_facts").alias("facts"), join("related_entities").alias("entities"))


@query(_KEPT + """, d AS (SELECT * FROM b_observation WHERE status = 'disputed'), t AS (SELECT concat('c-', CAST(split_part(observation_id, '-', 3) AS BIGINT) % 150) AS concept_id, min(observation_id) AS observation_id FROM d GROUP BY 1),
h AS (SELECT t.observation_id, event_id, ts, feedback_type, feedback_text FROM f JOIN t USING (concept_id) WHERE persistence <> 'task_temporary'),
a AS (SELECT observation_id, count(*) FILTER (feedback_type = 'negate') AS n_no, arg_max(event_id, (ts, event_id)) FILTER (feedback_type = 'correct') AS fix FROM h GROUP BY 1)
SELECT d.observation_id, evidence_beta + 3e0 * coalesce(n_no, 0) AS evidence_beta, CASE WHEN fix IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN fix IS NOT NULL THEN concat('fix-', fix) END AS superseded_by, object_text FROM (SELECT * FROM d) d LEFT JOIN a USING (observation_id)
UNION ALL SELECT concat('fix-', event_id), 1e0, 'candidate', NULL, feedback_text FROM h WHERE feedback_type = 'correct'""", FB, OBS)
def feedback_on_observations(spark, sf):
    obs = frame(spark, sf, OBS).filter("status = 'disputed'").withColumn("superseded_by", F.lit(None).cast("string"))
    target = obs.groupBy(F.concat(F.lit("c-"), F.split_part("observation_id", F.lit("-"), F.lit(3)).cast("long") % 150).alias("concept_id")).agg(F.min("observation_id").alias("observation_id"))
    out = history.corrected(frame(spark, sf, FB).join(target, "concept_id"), obs)
    return out.select("observation_id", "evidence_beta", "status", "superseded_by", "object_text")


_CUES = Q._class_sql("content", (("hit", vocab.CORRECTION_CUES),), "x")


@query(f" SELECT memory_id, {_CUES} = 'hit' AS correction, {Q._class_sql('content', vocab.PERSISTENCE_WORDS, 'scenario_specific')} AS scope FROM (SELECT memory_id, concat(content, CASE seq % 3 WHEN 0 THEN ' actually, from now on' WHEN 1 THEN ' that is wrong' ELSE '' END) AS content FROM b_raw_memory)", "b_raw_memory")
def correction_signals(spark, sf):
    raw = frame(spark, sf, "b_raw_memory")
    text = F.concat("content", F.when(F.col("seq") % 3 == 0, " actually, from now on").when(F.col("seq") % 3 == 1, " that is wrong").otherwise(""))
    told = raw.select("memory_id", text.alias("t")).withColumns({"implicit": S.correction_signal(F.col("t")), "explicit": S.correction_signal(F.col("t"), False)})
    return told.select("memory_id", F.col("implicit").isNotNull().alias("correction"), F.col("explicit.scope").alias("scope"))


# ---- promotion and maintenance ----

_COUNTS = f""", tri AS (SELECT subject_text, predicate, object_text, count(DISTINCT workspace_id) AS n FROM b_observation WHERE {LIVE} GROUP BY 1, 2, 3),
said AS (SELECT DISTINCT o.workspace_id, o.subject_text, o.object_text, n FROM b_observation o JOIN tri t ON o.subject_text = t.subject_text AND o.predicate = t.predicate AND o.object_text IS NOT DISTINCT FROM t.object_text),
ent AS (SELECT workspace_id, entity, max(n) AS n FROM (SELECT workspace_id, subject_text AS entity, n FROM said UNION ALL SELECT workspace_id, object_text, n FROM said) WHERE entity IS NOT NULL GROUP BY 1, 2),
cc AS (SELECT concept_id, greatest(coalesce(max(n), 1), 1) AS cross_project_count FROM (SELECT concept_id, workspace_id, unnest([entity_3, narrow, entity_1]) AS entity FROM b_concept) LEFT JOIN ent USING (workspace_id, entity) GROUP BY 1)"""
_DONE = _COUNTS + f""", pe AS (SELECT b_concept.*, cross_project_count, CASE WHEN status = 'disputed' THEN NULL WHEN cross_project_count >= 3 AND confidence >= 0.85 AND {Q._SESSIONS} >= 3 THEN 'global' WHEN cross_project_count >= 2 AND confidence >= 0.75 AND {Q._SESSIONS} >= 2 THEN 'domain' END AS to_scope FROM b_concept JOIN cc USING (concept_id)),
dn AS (SELECT *, coalesce(to_scope IS NOT NULL AND list_position(['project', 'domain', 'global'], to_scope) > list_position(['project', 'domain', 'global'], lifecycle_scope), false) AS changed FROM pe)"""


def _by_brand(spark, sf):
    return Q._con(spark, sf).withColumn("related_entities", F.array("entity_3", "narrow", "entity_1", "entity_2"))


def _promoted(spark, sf, key="parts"):
    con = _by_brand(spark, sf)
    counts = graph.related_counts(con, frame(spark, sf, OBS))
    rows = con.join(counts, "concept_id").withColumn("conflict_count", (F.col("status") == "disputed").cast("int"))
    return graph.promoted(graph.promotion(rows), key)


@query(_COUNTS + " SELECT concept_id, cross_project_count FROM cc", OBS, CON)
def related_cross_counts(spark, sf):
    return graph.related_counts(_by_brand(spark, sf), frame(spark, sf, OBS))


@query(_DONE + " SELECT concept_id, changed, CASE WHEN changed THEN to_scope ELSE lifecycle_scope END AS lifecycle_scope, CASE WHEN changed THEN CASE to_scope WHEN 'domain' THEN 'parts' END ELSE scope_key END AS scope_key, CASE WHEN to_scope IS NULL THEN NULL WHEN changed THEN to_scope ELSE lifecycle_scope END AS reported FROM dn", OBS, CON)
def promotion_applied(spark, sf):
    return _promoted(spark, sf).select("concept_id", "changed", "lifecycle_scope", "scope_key", "reported")


@query(_DONE + " SELECT concept_id, coalesce(changed AND to_scope = 'global', false) AS changed FROM dn", OBS, CON)
def promotion_without_key(spark, sf):
    return _promoted(spark, sf, None).select("concept_id", "changed")


_ALIAS = _DONE + Q.IDX + """, px AS (SELECT a.concept_id, b.concept_id AS peer_id, count(*) AS overlap FROM i a JOIN i b ON a.entity = b.entity AND a.workspace_id <> b.workspace_id WHERE a.concept_id IN (SELECT concept_id FROM dn WHERE changed) AND b.concept_id IN (SELECT concept_id FROM b_concept WHERE lifecycle_scope = 'project') GROUP BY 1, 2 HAVING count(*) >= 2),
best AS (SELECT px.*, row_number() OVER (PARTITION BY px.concept_id ORDER BY overlap DESC, c.confidence DESC, peer_id) AS n FROM px JOIN b_concept c ON c.concept_id = peer_id QUALIFY n = 1), al AS (SELECT min(concept_id) AS concept_id, peer_id, arg_min(overlap, concept_id) AS overlap FROM best GROUP BY 2)"""


@query(_ALIAS + " SELECT concept_id, peer_id, overlap FROM al", OBS, CON)
def promotion_aliases(spark, sf):
    return graph.promotion_aliases(_promoted(spark, sf), Q._con(spark, sf))


@query(_ALIAS + " SELECT concept_id, CASE WHEN concept_id IN (SELECT peer_id FROM al) THEN 'deprecated' ELSE status END AS status FROM b_concept", OBS, CON)
def aliased_concepts(spark, sf):
    con = Q._con(spark, sf)
    return graph.with_aliases(con, graph.promotion_aliases(_promoted(spark, sf), con)).select("concept_id", "status")


@query(f" SELECT concept_id, workspace_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY confidence DESC, concept_id) AS n FROM b_concept WHERE status = 'active' AND entity_3 = 'brand#11' AND workspace_id IN (SELECT workspace_id FROM b_observation WHERE {LIVE} AND subject_text = 'red_bolt' AND predicate = 'has' AND object_text = 'brand#11')) WHERE n <= 20 AND lifecycle_scope = 'project'", OBS, CON)
def promotion_fanout(spark, sf):
    return graph.promotion_candidates(Q._con(spark, sf), frame(spark, sf, OBS), ("red_bolt", "has", "brand#11"))


_DREAM = f""", r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, subject_text, predicate, object_text ORDER BY extraction_confidence * (evidence_alpha / (evidence_alpha + evidence_beta)) DESC, observation_id) AS rn FROM b_observation WHERE {STRICT}),
c AS (SELECT workspace_id, subject_text, object_text, {Q._CONFLICT} > 0 AS hit FROM b_observation WHERE {STRICT} GROUP BY 1, 2, 3),
s AS (SELECT r.*, hit, CASE WHEN rn > 1 THEN 'superseded' WHEN source_type = 'assistant_guess' AND evidence_alpha <= 1.2 AND evidence_alpha / (evidence_alpha + evidence_beta) < 0.45 THEN 'deprecated' ELSE status END AS new_status FROM r JOIN c ON r.workspace_id = c.workspace_id AND r.subject_text = c.subject_text AND r.object_text IS NOT DISTINCT FROM c.object_text)"""


@query(_DREAM + " SELECT workspace_id, count(*) FILTER (new_status = 'superseded') AS merged, count(*) FILTER (new_status <> 'superseded' AND hit) AS softened, count(*) FILTER (new_status = 'deprecated') AS archived, count(*) AS consolidated FROM s GROUP BY 1", OBS)
def dream_report(spark, sf):
    return ledger.maintenance_report(ledger.maintained(frame(spark, sf, OBS)))


@query(_DREAM + " SELECT b.observation_id, coalesce(s.new_status, b.status) AS status, s.observation_id IS NOT NULL AS consolidated FROM b_observation b LEFT JOIN s ON s.observation_id = b.observation_id", OBS)
def dream_ledger(spark, sf):
    return ledger.after_maintenance(frame(spark, sf, OBS)).select("observation_id", "status", F.coalesce("consolidated", F.lit(False)).alias("consolidated"))


@query(Q._LINK + """, hot AS (SELECT workspace_id, count(*) AS n FROM (SELECT workspace_id, entity FROM i0 GROUP BY ALL HAVING count(*) > 8) GROUP BY 1), ws AS (SELECT workspace_id FROM b_concept GROUP BY 1), cw AS (SELECT concept_id, workspace_id FROM b_concept)
SELECT workspace_id, (SELECT count(*) FROM sh WHERE sh.workspace_id = ws.workspace_id) AS shared_entity_evidence, (SELECT count(*) FROM ba JOIN cw ON src = concept_id WHERE cw.workspace_id = ws.workspace_id) AS coclaim_evidence, (SELECT count(*) FROM ca JOIN cw ON src = concept_id WHERE cw.workspace_id = ws.workspace_id) AS causal_evidence, coalesce((SELECT n FROM hot WHERE hot.workspace_id = ws.workspace_id), 0) AS skipped_hot_entities FROM ws""", CON, "b_cause_timed", "b_claim")
def link_report(spark, sf):
    con, narrow = Q._con(spark, sf), Q._narrow(spark, sf)
    return graph.link_report(con, graph.shared_entity_count(con), graph.batch_count(narrow, frame(spark, sf, "b_claim")), graph.causes_count(narrow, frame(spark, sf, "b_cause_timed")))


# ---- scalars ----


@query(" SELECT p_partkey, CASE k " + " ".join(f"WHEN '{w}' THEN '{k}'" for k, words in vocab.PREDICATES.items() for w in words) + " ELSE k END AS predicate FROM (SELECT p_partkey, lower(replace(trim(t), ' ', '_')) AS k FROM (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN ' Depends on' WHEN 1 THEN 'lacks' WHEN 2 THEN 'Leads To' WHEN 3 THEN 'HAS' WHEN 4 THEN 'uses ' WHEN 5 THEN 'links_to' WHEN 6 THEN 'unrelated' WHEN 7 THEN 'without' ELSE p_name END AS t FROM part))")
def predicate_normalize(spark, sf):
    text = F.expr("CASE p_size % 9 WHEN 0 THEN ' Depends on' WHEN 1 THEN 'lacks' WHEN 2 THEN 'Leads To' WHEN 3 THEN 'HAS' WHEN 4 THEN 'uses ' WHEN 5 THEN 'links_to' WHEN 6 THEN 'unrelated' WHEN 7 THEN 'without' ELSE p_name END")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", S.predicate_key(text).alias("predicate"))


_ENDINGS = ("Model", "_service_table", "Manager", "config", " Data-Type", "")


@query(None)
def entity_key_aggressive(spark, sf):
    endings = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", S.key_aggressive(F.concat(F.initcap("p_name"), endings)).alias("entity_key"))


@query(" SELECT memory_id, array_to_string(list_concat(['red'], list_filter(list_transform(list_filter(string_split_regex(content, '[^\\p{L}\\p{N}_\\-\\x{80}-\\x{10FFFF}]+'), lambda p: len(p) >= 2), lambda p: regexp_replace(regexp_replace(lower(p), '[ _-]+', '_', 'g'), '_+$', '')), lambda x: x <> '' AND x <> 'red' AND x NOT IN STOP)), ' ') AS entities FROM b_raw_memory".replace("STOP", listed(vocab.FEEDBACK_STOPWORDS)), "b_raw_memory")
def merged_entities(spark, sf):
    held = F.array(F.lit("red"))
    return frame(spark, sf, "b_raw_memory").select("memory_id", F.array_join(S.merged_entities(held, F.col("content")), " ").alias("entities"))


@query(""" SELECT concept_id, array_to_string(CASE WHEN list_contains(f, n) THEN f ELSE list_append(f, n) END, ';') AS facts FROM (SELECT concept_id, from_json(facts_json, '["VARCHAR"]') AS f, concat('fits brand#', concept_no % 25) AS n FROM (SELECT *, CAST(split_part(concept_id, '-', 2) AS BIGINT) AS concept_no FROM b_module))""", MOD)
def append_items(spark, sf):
    number = F.split_part("concept_id", F.lit("-"), F.lit(2)).cast("long") % 25
    return _mod(spark, sf).select("concept_id", F.array_join(S.appended(F.col("known_facts"), F.concat(F.lit("fits brand#"), number)), ";").alias("facts"))


@query(" SELECT event_id, round(floor(greatest(epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts), 0) / 1e6) / 86400e0, 4) AS days FROM b_feedback_events", FB)
def days_since(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return frame(spark, sf, FB).select("event_id", F.round(S.days_since(now, F.col("ts").cast("timestamp")), 4).alias("days"))


@query(" SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'a|b' ELSE text END AS items FROM conversations")
def tolerant_items(spark, sf):
    raw = F.when(F.col("turn") % 2 == 0, '["a","","b"]').otherwise(F.col("text"))
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.array_join(S.tolerant_items(raw), "|").alias("items"))
