"""Registered queries of the engine and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import clusters, graph, history, ledger, vectors
from corrolith.plans import registry
from corrolith.plans.bridge import frame

_query, _in = registry.query, registry.listed

LIVE = f"status NOT IN {_in(vocab.DEAD)}"
STRICT = f"status IN {_in(vocab.STRICT)}"
OBS = "b_observation"


def _obs(spark, sf):
    return frame(spark, sf, OBS)


@_query(f""", c AS (SELECT subject_text, predicate, object_text, count(DISTINCT workspace_id) AS n FROM b_observation WHERE {LIVE} GROUP BY ALL)
SELECT observation_id, n AS cross_project_count FROM b_observation o JOIN c ON o.subject_text = c.subject_text AND o.predicate = c.predicate AND o.object_text IS NOT DISTINCT FROM c.object_text WHERE {LIVE}""", OBS)
def cross_project_count(spark, sf):
    return ledger.cross_workspace_count(_obs(spark, sf)).select("observation_id", "cross_project_count")


@_query(" SELECT observation_id, subject_text, predicate, object_text FROM b_observation WHERE workspace_id = 'ws-1' AND status = 'confirmed'", OBS)
def observations_by_status(spark, sf):
    return ledger.by_status(_obs(spark, sf), "ws-1", "confirmed").select("observation_id", *ledger.TRIPLE)


@_query(" SELECT observation_id, status FROM b_observation WHERE workspace_id = 'ws-1' AND (subject_text = 'brand#11' OR object_text = 'brand#11')", OBS)
def find_by_entity(spark, sf):
    return ledger.by_entity(_obs(spark, sf), "ws-1", "brand#11").select("observation_id", "status")


@_query(f" SELECT workspace_id, subject_text, predicate, object_text, arg_min(observation_id, (created_ts, observation_id)) AS observation_id, count(*) AS n_rows FROM b_observation WHERE {LIVE} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1", OBS)
def oldest_live_duplicate(spark, sf):
    return ledger.oldest_live(_obs(spark, sf))


@_query(" SELECT DISTINCT a.observation_id AS a, b.observation_id AS b FROM b_observation a JOIN b_observation b USING (extraction_batch_id) WHERE a.observation_id < b.observation_id", OBS)
def coclaim_pairs(spark, sf):
    return ledger.coclaim_pairs(_obs(spark, sf))


@_query(f", w AS (SELECT * FROM b_observation WHERE substr(subject_text, 1, 1) IN ('b', 'm')) SELECT observation_id, status FROM b_observation WHERE {LIVE} AND extraction_batch_id IN (SELECT extraction_batch_id FROM w) AND observation_id NOT IN (SELECT observation_id FROM w)", OBS)
def coclaim_siblings(spark, sf):
    obs = _obs(spark, sf)
    return ledger.coclaim_siblings(obs, obs.filter("substr(subject_text, 1, 1) IN ('b', 'm')")).select("observation_id", "status")


@_query(""", n AS (SELECT workspace_id, session_id, extraction_version, count(*) AS n_messages FROM b_raw_memory WHERE extraction_version IS NOT NULL GROUP BY ALL)
SELECT workspace_id, session_id, extraction_version, n_messages FROM n QUALIFY row_number() OVER (PARTITION BY workspace_id, session_id ORDER BY n_messages DESC, extraction_version) = 1""", "b_raw_memory")
def session_version_mode(spark, sf):
    return ledger.version_mode(frame(spark, sf, "b_raw_memory"))


@_query(f" SELECT workspace_id, subject_text, predicate, object_text, count(*) AS n_rows FROM b_observation WHERE {STRICT} GROUP BY ALL HAVING count(*) > 1", OBS)
def dream_merge(spark, sf):
    return ledger.duplicates(_obs(spark, sf))


_CONFLICT = " + ".join(f"CAST(bool_or(predicate = '{p}') AND bool_or(predicate = '{q}') AS INT)" for p, q in vocab.NEGATIONS)


@_query(f" SELECT * FROM (SELECT workspace_id, subject_text, object_text, CAST({_CONFLICT} AS INT) AS n_conflicts FROM b_observation WHERE {STRICT} GROUP BY 1, 2, 3) WHERE n_conflicts > 0", OBS)
def dream_conflicts(spark, sf):
    return ledger.conflicts(_obs(spark, sf))


@_query(f" SELECT observation_id FROM b_observation WHERE {STRICT} AND source_type = 'assistant_guess' AND evidence_alpha <= 1.2 AND evidence_alpha / (evidence_alpha + evidence_beta) < 0.45", OBS)
def dream_lowvalue(spark, sf):
    return ledger.low_value(_obs(spark, sf)).select("observation_id")


@_query(f""", r AS (SELECT *, row_number() OVER w AS rn, first_value(observation_id) OVER w AS keep, count(*) OVER (PARTITION BY workspace_id, subject_text, predicate, object_text) AS n FROM b_observation WHERE {STRICT}
  WINDOW w AS (PARTITION BY workspace_id, subject_text, predicate, object_text ORDER BY extraction_confidence * (evidence_alpha / (evidence_alpha + evidence_beta)) DESC, observation_id)),
c AS (SELECT workspace_id, subject_text, object_text, {_CONFLICT} > 0 AS hit FROM b_observation WHERE {STRICT} GROUP BY 1, 2, 3)
SELECT observation_id, CASE WHEN rn = 1 AND NOT hit THEN evidence_alpha + n - 1 ELSE evidence_alpha END AS evidence_alpha, CASE WHEN rn = 1 AND hit THEN evidence_beta + 2 ELSE evidence_beta END AS evidence_beta,
  CASE WHEN rn > 1 THEN 'superseded' WHEN source_type = 'assistant_guess' AND evidence_alpha <= 1.2 AND evidence_alpha / (evidence_alpha + evidence_beta) < 0.45 THEN 'deprecated' ELSE status END AS status,
  CASE WHEN rn > 1 THEN concat('dream-merge:', keep) END AS superseded_by
FROM r JOIN c ON r.workspace_id = c.workspace_id AND r.subject_text = c.subject_text AND r.object_text IS NOT DISTINCT FROM c.object_text""", OBS)
def dream_state(spark, sf):
    return ledger.maintained(_obs(spark, sf)).drop("workspace_id", "consolidated", "softened")


# ---- concepts and edges ----

CON = "b_concept"
IDX = ", i AS (SELECT workspace_id, concept_id, unnest(list_distinct([narrow, entity_1, entity_2, entity_3])) AS entity FROM b_concept WHERE status = 'active')"
NARROW = ", i AS (SELECT workspace_id, concept_id, narrow AS entity FROM b_concept WHERE status = 'active')"


def _con(spark, sf):
    return frame(spark, sf, CON)


def _narrow(spark, sf):
    return _con(spark, sf).withColumn("related_entities", F.array("narrow"))


@_query(" SELECT concept_id, workspace_id, status FROM b_concept WHERE workspace_id = 'ws-1' OR lifecycle_scope = 'global' OR (lifecycle_scope = 'domain' AND scope_key IN ('promo', 'standard'))", CON)
def visible_concepts(spark, sf):
    return graph.visible(_con(spark, sf), "ws-1", ["promo", "standard"]).select("concept_id", "workspace_id", "status")


@_query(" SELECT concept_id, round(confidence, 6) AS confidence FROM b_concept WHERE workspace_id = 'ws-1' AND status = 'active' AND (entity_3 IN ('brand#11', 'brand#12') OR entity_1 IN ('brand#11', 'brand#12') OR entity_2 IN ('brand#11', 'brand#12')) ORDER BY confidence DESC, concept_id LIMIT 20", CON)
def find_by_entities_topk(spark, sf):
    return graph.owners_topk(_con(spark, sf), "ws-1", ["brand#11", "brand#12"]).select("concept_id", F.round("confidence", 6).alias("confidence"))


@_query(" SELECT DISTINCT workspace_id, unnest([narrow, entity_1, entity_2, entity_3]) AS entity FROM b_concept", CON)
def entity_vocabulary(spark, sf):
    return graph.vocabulary(_con(spark, sf))


@_query(IDX + " SELECT a.concept_id, b.concept_id AS peer_id, count(*) AS overlap FROM i a JOIN i b ON a.entity = b.entity AND a.workspace_id <> b.workspace_id WHERE b.concept_id IN (SELECT concept_id FROM b_concept WHERE lifecycle_scope = 'project') GROUP BY 1, 2", CON)
def cross_workspace_peers(spark, sf):
    return graph.peers(_con(spark, sf))


_SHARED = IDX + ", f AS (SELECT workspace_id, entity FROM i GROUP BY ALL HAVING count(*) <= 8), sh AS (SELECT a.workspace_id, a.concept_id AS src, b.concept_id AS dst, 'shared_entity' AS relation_type, 'repeated_occurrence' AS evidence FROM i a JOIN i b USING (workspace_id, entity) JOIN f USING (workspace_id, entity) WHERE a.concept_id < b.concept_id)"
_DELTA = ["CASE evidence " + " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in vocab.EVIDENCE.items()) + " END" for i in (0, 1)]


def _fold(events: str) -> str:
    return f""" SELECT src, dst, relation_type, alpha, beta, evidence_count, round(alpha / (alpha + beta), 6) AS weight, CASE WHEN sure THEN 'confirmed' WHEN alpha / (alpha + beta) >= 0.7 AND evidence_count >= 3 THEN 'validated' ELSE 'candidate' END AS lifecycle FROM (
SELECT src, dst, relation_type, 1 + sum({_DELTA[0]}) AS alpha, 1 + sum({_DELTA[1]}) AS beta, count(*) FILTER ({_DELTA[0]} + {_DELTA[1]} <> 0) AS evidence_count, bool_or(evidence IN ('user_confirmation', 'human_review_confirm')) AS sure FROM {events} GROUP BY 1, 2, 3)"""


def newest() -> list:
    """Order of causes in an edge: the newest first; the rest tells rows of one time apart."""
    return [F.desc("created_ts"), "observation_id", "evidence"]


def _fold_ordered(events: str, order: str) -> str:
    """As _fold, with the highest state reached at any prefix of the events."""
    return f""" SELECT src, dst, relation_type, max(a) AS alpha, max(b) AS beta, max(n) AS evidence_count, round(max(a) / (max(a) + max(b)), 6) AS weight,
CASE max(CASE WHEN evidence IN ('user_confirmation', 'human_review_confirm') THEN 2 WHEN a / (a + b) >= 0.7 AND n >= 3 THEN 1 ELSE 0 END) WHEN 2 THEN 'confirmed' WHEN 1 THEN 'validated' ELSE 'candidate' END AS lifecycle FROM (
SELECT src, dst, relation_type, evidence, 1 + sum({_DELTA[0]}) OVER w AS a, 1 + sum({_DELTA[1]}) OVER w AS b, count(*) FILTER ({_DELTA[0]} + {_DELTA[1]} <> 0) OVER w AS n
FROM {events} WINDOW w AS (PARTITION BY src, dst, relation_type ORDER BY {order} ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2, 3"""


#: Digits of weights that queries show.
DIGITS = 6


def _shown(df):
    return df.select("src", "dst", "relation_type", "alpha", "beta", "evidence_count", "weight", "lifecycle")


def _edges(df):
    return _shown(df.withColumn("weight", F.round("weight", DIGITS)))


@_query(_SHARED + _fold("sh"), CON)
def shared_entity_edges(spark, sf):
    return _edges(graph.fold_edges(graph.shared_entity_events(_con(spark, sf))))


_CAUSES = NARROW + """, ca AS (SELECT least(a.concept_id, b.concept_id) AS src, greatest(a.concept_id, b.concept_id) AS dst, 'shared_entity' AS relation_type,
  CASE source_type WHEN 'file_evidence' THEN 'file_evidence' WHEN 'user_confirm' THEN 'user_confirmation' WHEN 'user_negation' THEN 'user_negation' WHEN 'assistant_guess' THEN 'assistant_speculation' ELSE 'repeated_occurrence' END AS evidence
  FROM b_cause o JOIN i a ON o.workspace_id = a.workspace_id AND o.subject_text = a.entity JOIN i b ON o.workspace_id = b.workspace_id AND o.object_text = b.entity WHERE a.concept_id <> b.concept_id)"""


_CAUSES_TIMED = _CAUSES.replace("b_cause o", "b_cause_timed o").replace(" AS evidence\n", " AS evidence, created_ts, observation_id\n")


@_query(_CAUSES_TIMED + _fold_ordered("ca", "created_ts DESC, observation_id, evidence"), CON, "b_cause_timed")
def causes_edges(spark, sf):
    return _shown(graph.causes_edges(_narrow(spark, sf), frame(spark, sf, "b_cause_timed"), newest(), digits=DIGITS))


_BATCH = NARROW + """, m AS (SELECT DISTINCT o.workspace_id, extraction_batch_id, concept_id FROM b_cause o JOIN i ON o.workspace_id = i.workspace_id AND o.subject_text = i.entity),
ba AS (SELECT a.concept_id AS src, b.concept_id AS dst, 'shared_session' AS relation_type, 'repeated_occurrence' AS evidence FROM m a JOIN m b USING (workspace_id, extraction_batch_id) WHERE a.concept_id < b.concept_id)"""


@_query(_BATCH.replace("b_cause o JOIN", f"(SELECT * FROM b_claim WHERE {STRICT}) o JOIN") + _fold("ba"), CON, "b_claim")
def batch_edges(spark, sf):
    return _shown(graph.batch_edges(_narrow(spark, sf), frame(spark, sf, "b_claim"), DIGITS))


_LINK = _SHARED.replace(", i AS", ", i0 AS").replace("FROM i ", "FROM i0 ").replace("JOIN i ", "JOIN i0 ") + _CAUSES.replace("b_cause o", "b_cause_timed o").replace(" AS evidence\n", " AS evidence, created_ts, observation_id\n") + _BATCH.removeprefix(NARROW).replace("b_cause o JOIN", f"(SELECT * FROM b_claim WHERE {STRICT}) o JOIN") + """,
ev AS (SELECT src, dst, relation_type, evidence, 0 AS phase, CAST(NULL AS TIMESTAMP) AS created_ts, CAST(NULL AS VARCHAR) AS observation_id FROM sh UNION ALL SELECT src, dst, relation_type, evidence, 1, NULL, NULL FROM ba UNION ALL SELECT src, dst, relation_type, evidence, 2, created_ts, observation_id FROM ca)"""


@_query(_LINK + _fold_ordered("ev", "phase, created_ts DESC, observation_id, evidence"), CON, "b_cause_timed", "b_claim")
def edge_evidence_fold(spark, sf):
    con, narrow = _con(spark, sf), _narrow(spark, sf)
    return _shown(graph.link_edges(con, narrow, frame(spark, sf, "b_claim"), frame(spark, sf, "b_cause_timed"), ["phase", *newest()], DIGITS))


@_query(_SHARED + """, e AS (SELECT src, dst, (1 + count(*)) / (2.0 + count(*)) AS weight FROM sh GROUP BY 1, 2), u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5""", CON)
def neighbors_topk(spark, sf):
    return graph.neighbours(graph.fold_edges(graph.shared_entity_events(_con(spark, sf)))).select("src", "dst", "rank")


_SESSIONS = "greatest(connection_count, recall_count, 1)"


@_query(f""", w AS (SELECT narrow, count(DISTINCT workspace_id) AS n FROM b_concept GROUP BY 1)
SELECT concept_id, CASE WHEN status = 'disputed' THEN NULL WHEN n >= 3 AND confidence >= 0.85 AND {_SESSIONS} >= 3 THEN 'global' WHEN n >= 2 AND confidence >= 0.75 AND {_SESSIONS} >= 2 THEN 'domain' END AS to_scope FROM b_concept JOIN w USING (narrow)""", CON)
def promotion_eval(spark, sf):
    con = _con(spark, sf)
    seen = con.groupBy("narrow").agg(F.count_distinct("workspace_id").alias("cross_project_count"))
    rows = con.join(seen, "narrow").withColumn("conflict_count", (F.col("status") == "disputed").cast("int"))
    return graph.promotion(rows).select("concept_id", "to_scope")


# ---- timeline and feedback ----

TL = "b_timeline_events"


@_query(""" SELECT seq, entity, property, value, lead(seq) OVER w AS superseded_by, substr(CAST(lead(valid_from) OVER w AS VARCHAR), 1, 19) AS valid_to, CASE WHEN lead(seq) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status
FROM b_timeline_events WINDOW w AS (PARTITION BY workspace_id, entity, property ORDER BY valid_from, seq)""", TL)
def timeline_versions(spark, sf):
    return history.versions(frame(spark, sf, TL)).select("seq", "entity", "property", "value", "superseded_by", F.substring(F.col("valid_to").cast("string"), 1, 19).alias("valid_to"), "status")


@_query(" SELECT workspace_id, entity, property, arg_max(seq, (valid_from, seq)) AS seq, arg_max(value, (valid_from, seq)) AS value, count(*) AS n_versions FROM b_timeline_events GROUP BY 1, 2, 3", TL)
def timeline_current(spark, sf):
    return history.current(frame(spark, sf, TL))


def _class_sql(text: str, tables, otherwise: str) -> str:
    def hit(w: str) -> str:
        w = w.replace("'", "''")
        if w.isascii() or len(w) == 1:
            return rf"regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}_-]){w}($|[^\p{{L}}\p{{N}}_-])')"
        return f"contains(lower({text}), '{w}')"

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(hit, words))} THEN '{name}'" for name, words in tables) + f" ELSE '{otherwise}' END"


FB = "b_feedback_events"
_PERSIST = _class_sql("feedback_text", vocab.PERSISTENCE_WORDS, "scenario_specific")
_TYPE = f"CASE WHEN {_PERSIST} = 'task_temporary' THEN 'general' ELSE {_class_sql('feedback_text', vocab.FEEDBACK_WORDS, 'general')} END"


@_query(f" SELECT event_id, {_PERSIST} AS persistence, {_TYPE} AS feedback_type FROM b_feedback_events", FB)
def feedback_classify(spark, sf):
    return history.classified(frame(spark, sf, FB)).select("event_id", "persistence", "feedback_type")


_FD = ["CASE feedback_type " + " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in vocab.FEEDBACK.items()) + " END" for i in (0, 1)]


@_query(f""", f AS (SELECT *, {_PERSIST} AS persistence, {_TYPE} AS feedback_type FROM b_feedback_events),
r AS (SELECT concept_id, status, feedback_type, evidence_alpha + sum({_FD[0]}) OVER w AS a, evidence_beta + sum({_FD[1]}) OVER w AS b FROM f JOIN b_concept USING (concept_id) WHERE persistence <> 'task_temporary' WINDOW w AS (PARTITION BY concept_id ORDER BY ts, event_id))
SELECT concept_id, max(a) AS evidence_alpha, max(b) AS evidence_beta, CASE WHEN bool_or(a / (a + b) < 0.4) AND any_value(status) IN ('active', 'labile') THEN 'deprecated' ELSE any_value(status) END AS status,
  count(*) FILTER (feedback_type IN ('confirm', 'supplement', 'preference')) AS successful, count(*) FILTER (feedback_type IN ('negate', 'correct')) AS failed, count(*) AS n_feedback FROM r GROUP BY 1""", FB, CON)
def feedback_fold(spark, sf):
    return history.folded(frame(spark, sf, FB), _con(spark, sf))


@_query(f" SELECT memory_id, {_class_sql('content', vocab.INTENT_WORDS, 'general_query')} AS intent, {_class_sql('content', vocab.PERSISTENCE_WORDS, 'scenario_specific')} AS persistence, CAST(greatest(1, ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM b_raw_memory", "b_raw_memory")
def intent_classify(spark, sf):
    text = F.col("content")
    return frame(spark, sf, "b_raw_memory").select("memory_id", S.intent_class(text).alias("intent"), S.persistence_class(text).alias("persistence"), S.tokens(text).alias("tokens"))


# ---- scalars ----


@_query(r" SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[ _-]+', '_', 'g'), '_+$', '') AS entity_key FROM part")
def entity_key_light(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", S.key_light(F.col("p_name")).alias("entity_key"))


@_query(f""" SELECT observation_id, round(evidence_alpha / (evidence_alpha + evidence_beta), 6) AS fact, round(extraction_confidence * (evidence_alpha / (evidence_alpha + evidence_beta)), 6) AS effective,
 round(CASE source_type {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in vocab.SOURCE_FACTOR.items())} END * least(1 + 0.25e0 * (greatest(CAST(evidence_alpha AS INT), 1) - 1), 2e0), 6) AS weight FROM b_observation""", OBS)
def beta_confidence(spark, sf):
    weight = S.heterogeneous_weight(F.lit(1.0), F.col("source_type"), F.col("evidence_alpha").cast("int"))
    return _obs(spark, sf).select("observation_id", F.round(S.fact_confidence(), 6).alias("fact"), F.round(S.effective_confidence(), 6).alias("effective"), F.round(weight, 6).alias("weight"))


@_query(" SELECT concept_id, round(exp(-(1 / 90e0) / (1 + 0.5e0 * successful_recall_count) * recall_count * 7), 6) AS recency FROM b_concept", CON)
def recency_decay(spark, sf):
    return _con(spark, sf).select("concept_id", F.round(S.recency(F.col("recall_count") * 7.0, F.col("successful_recall_count")), 6).alias("recency"))


# ---- vectors ----

EMB = "b_embedding"
_COS = "list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))))"


@_query(f" SELECT a.source_id, round({_COS}, 6) AS score FROM b_embedding a, b_embedding b WHERE b.source_id = 'v-0' ORDER BY {_COS} DESC, a.source_id LIMIT 10", EMB)
def cosine_topk(spark, sf):
    emb = frame(spark, sf, EMB)
    return vectors.topk(emb, emb.filter("source_id = 'v-0'")).select("source_id", F.round("score", 6).alias("score"))


_PAIRS = f", p AS (SELECT a.source_id AS a, b.source_id AS b, 1 - {_COS} AS distance FROM b_embedding a JOIN b_embedding b ON a.workspace_id = b.workspace_id AND a.source_id < b.source_id)"


def _near(spark, sf):
    """Pairs of vectors of a workspace, of its 5000 first at most, as clustering considers them."""
    return clusters.near_pairs(frame(spark, sf, EMB), clusters.Clustering(threshold=0.65), "source_id", "source_id")


@_query(_PAIRS + " SELECT a, b, round(distance, 6) AS distance FROM p WHERE distance <= 0.65", EMB)
def similarity_pairs(spark, sf):
    return _near(spark, sf).select("a", "b", F.round("distance", 6).alias("distance"))


@_query(_PAIRS + ", l AS (SELECT a, b FROM p WHERE distance <= 0.65), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT source_id AS node, source_id AS o FROM b_embedding UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.o) SELECT node, min(o) AS label FROM r GROUP BY 1", EMB)
def cluster_components(spark, sf):
    return vectors.components(frame(spark, sf, EMB).select(F.col("source_id").alias("node")), _near(spark, sf))


@_query(""", x AS (SELECT concept_id, row_number() OVER (ORDER BY confidence DESC, concept_id) - 1 AS r FROM b_concept WHERE status = 'active'), y AS (SELECT concept_id, row_number() OVER (ORDER BY recall_count DESC, concept_id) - 1 AS r FROM b_concept WHERE status = 'active'),
u AS (SELECT * FROM x WHERE r < 100 UNION ALL SELECT * FROM y WHERE r < 100) SELECT concept_id, round(sum(1e0 / (61 + r)), 6) AS score FROM u GROUP BY 1""", CON)
def rrf_fuse(spark, sf):
    from pyspark.sql import Window

    rows = _con(spark, sf).filter("status = 'active'")
    lists = []
    for c in ("confidence", "recall_count"):
        top = rows.orderBy(F.desc(c), "concept_id").limit(100)  # a ranked list of the 100 best is the input of the fusion
        lists.append(top.select(F.col("concept_id").alias("id"), (F.row_number().over(Window.orderBy(F.desc(c), "concept_id")) - 1).alias("rank")))
    return vectors.fuse(lists[0].union(lists[1])).select(F.col("id").alias("concept_id"), F.round("score", 6).alias("score"))


@_query(" SELECT memory_id, CAST(used AS BIGINT) AS used FROM (SELECT memory_id, sum(greatest(1, ceil(length(content) / 4.0))) OVER (PARTITION BY session_id ORDER BY seq, memory_id) AS used FROM b_raw_memory) WHERE used <= 1500", "b_raw_memory")
def context_budget(spark, sf):
    raw = frame(spark, sf, "b_raw_memory").withColumn("size", S.tokens(F.col("content")))
    return vectors.within_budget(raw, "session_id", ["seq", "memory_id"], "size", 1500).select("memory_id", "used")


@_query(" SELECT DISTINCT concept_id FROM b_feedback_events f WHERE NOT EXISTS (SELECT 1 FROM b_concept c WHERE c.concept_id = f.concept_id AND status = 'active')", FB, CON)
def fk_violations(spark, sf):
    return ledger.missing_references(frame(spark, sf, FB), "concept_id", _con(spark, sf).filter("status = 'active'"), "concept_id").select("concept_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries of the engine."""
    return {k: f for k, (f, _) in registry.ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in registry.ALL.items() if s}
