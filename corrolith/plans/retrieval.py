"""Registered queries of retrieval. One query text, one workspace and one vector stand for what a caller would ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import graph, recall, vectors
from corrolith.plans.bridge import frame
from corrolith.plans.registry import listed, query

TEXT, WORKSPACE, NOW = "Red bolt", "ws-1", "2026-01-01T00:00:00Z"
SEE = recall.Visibility(("promo", "standard"), True)
#: Shapes that the SQL below reads.
SHAPES = ("b_module", "b_embedding", "b_claim")
MOD, EMB, CLAIM = SHAPES

_ELEVATED = f"(lifecycle_scope = 'global' OR (lifecycle_scope = 'domain' AND scope_key IN {listed(SEE.domains)}))"
_SEEN = f"(workspace_id = '{WORKSPACE}' OR {_ELEVATED})"
_Q = TEXT.lower()
_TOKENS = "['" + "','".join(t for t in _Q.split() if len(t) >= 2) + "']"


def _hits(x: str) -> str:
    return f"len(list_filter({_TOKENS}, lambda t: contains(lower({x}), t)))"


def _has(x: str, points: str) -> str:
    return f"CASE WHEN contains(lower({x}), '{_Q}') THEN {points} ELSE 0e0 END"


_LEXICAL = f"({_has('name', '3e0')} + CASE WHEN definition IS NULL THEN 0e0 ELSE {_has('definition', '2e0')} + 0.5e0 * {_hits('definition')} END + CASE WHEN entities_json IS NULL THEN 0e0 ELSE {_has('entities_json', '2.5e0')} + 0.8e0 * {_hits('entities_json')} END + CASE WHEN facts_json IS NULL THEN 0e0 ELSE {_has('facts_json', '1.5e0')} END)"
_LEX = f""", m AS (SELECT *, from_json(entities_json, '["VARCHAR"]') AS ents FROM b_module), vis AS (SELECT * FROM m WHERE {_SEEN}),
lex AS (SELECT concept_id, score, row_number() OVER (ORDER BY score DESC, concept_id) - 1 AS r FROM (SELECT concept_id, {_LEXICAL} AS score FROM vis WHERE status = 'active') WHERE score > 0 QUALIFY r < 8)"""
_COS = "list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))))"


def _dense(k: int) -> str:
    return f""", near AS (SELECT a.source_type, a.source_id, {_COS} AS score FROM b_embedding a, b_embedding b WHERE b.source_id = 'v-0'
  AND (a.workspace_id = '{WORKSPACE}' OR (a.source_type = 'concept' AND a.source_id IN (SELECT concept_id FROM b_module WHERE {_ELEVATED})))),
dense_all AS (SELECT * FROM near WHERE score >= 0 ORDER BY score DESC, source_id LIMIT {k}),
den AS (SELECT source_id AS concept_id, score, row_number() OVER (ORDER BY score DESC, source_id) - 1 AS r FROM dense_all WHERE source_type = 'concept')"""


_SEED = _LEX + _dense(8) + """, seed AS (SELECT concept_id, coalesce(1e0 / (60 + l.r + 1), 0e0) + coalesce(1e0 / (60 + d.r + 1), 0e0) AS score, l.r AS lexical_rank, d.r AS dense_rank
  FROM (SELECT * FROM lex) l FULL JOIN den d USING (concept_id) ORDER BY score DESC, concept_id LIMIT 8),
first AS (SELECT concept_id FROM seed ORDER BY score DESC, concept_id LIMIT 5)"""
#: Edges of concepts that share an entity or a batch, as the linking queries fold them.
_EDGES = """, oi AS (SELECT workspace_id, concept_id, unnest(list_distinct(ents)) AS entity FROM m WHERE status = 'active'),
rare AS (SELECT workspace_id, entity FROM oi GROUP BY ALL HAVING count(*) <= 8),
said AS (SELECT DISTINCT c.workspace_id, extraction_batch_id, concept_id FROM b_claim c JOIN oi ON oi.workspace_id = c.workspace_id AND entity = subject_text WHERE c.status IN STRICT),
edge AS (SELECT workspace_id, a.concept_id AS src, b.concept_id AS dst, 'shared_entity' AS relation_type, (1 + count(*)) / (2e0 + count(*)) AS weight FROM oi a JOIN oi b USING (workspace_id, entity) JOIN rare USING (workspace_id, entity) WHERE a.concept_id < b.concept_id GROUP BY ALL
  UNION ALL SELECT workspace_id, a.concept_id, b.concept_id, 'shared_session', (1 + count(*)) / (2e0 + count(*)) FROM said a JOIN said b USING (workspace_id, extraction_batch_id) WHERE a.concept_id < b.concept_id GROUP BY ALL)""".replace("STRICT", listed(vocab.STRICT))
_FORWARD = f""", both_ends AS (SELECT src, dst, relation_type, weight FROM edge WHERE workspace_id = '{WORKSPACE}' UNION ALL SELECT dst, src, relation_type, weight FROM edge WHERE workspace_id = '{WORKSPACE}'),
strongest AS (SELECT src, dst, relation_type, weight FROM both_ends WHERE src IN (SELECT concept_id FROM first) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, relation_type) <= 5),
fwd AS (SELECT dst AS concept_id, sum(weight) * 0.675e0 AS score FROM strongest WHERE dst NOT IN (SELECT concept_id FROM first) AND dst IN (SELECT concept_id FROM vis WHERE status IN ('active', 'disputed')) GROUP BY 1)"""
_REVERSE = f""", wanted AS (SELECT DISTINCT lower(e) AS entity FROM (SELECT unnest(ents) AS e FROM m WHERE concept_id IN (SELECT concept_id FROM first))),
owned AS (SELECT concept_id, entity FROM (SELECT concept_id, confidence, unnest(list_distinct(ents)) AS entity FROM m WHERE status = 'active' AND workspace_id = '{WORKSPACE}') WHERE entity IN (SELECT entity FROM wanted)
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, concept_id) <= 20),
elsewhere AS (SELECT DISTINCT concept_id, lower(e) AS entity FROM (SELECT concept_id, unnest(ents) AS e FROM vis WHERE status = 'active' AND workspace_id <> '{WORKSPACE}') WHERE lower(e) IN (SELECT entity FROM wanted)),
rev AS (SELECT concept_id, sum(points) AS score FROM (SELECT concept_id, 0.50625e0 AS points FROM owned UNION ALL SELECT concept_id, 0.50625e0 * 0.8e0 FROM elsewhere) WHERE concept_id NOT IN (SELECT concept_id FROM first) GROUP BY 1)"""
_COMPACT = _SEED + _EDGES + _FORWARD + _REVERSE + """, hits AS (SELECT concept_id, round(sum(score), 6) AS score, max(lexical_rank) AS lexical_rank, max(dense_rank) AS dense_rank FROM (
  SELECT concept_id, score, lexical_rank, dense_rank FROM seed UNION ALL SELECT concept_id, score, NULL, NULL FROM fwd UNION ALL SELECT concept_id, score, NULL, NULL FROM rev) GROUP BY 1 ORDER BY score DESC, concept_id LIMIT 8)"""


def _mod(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, MOD)


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, EMB)


def _vector(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).filter("source_id = 'v-0'").select("vector")


def _edges(spark: SparkSession, sf: str, seeds: DataFrame) -> DataFrame:
    """The seeds' edges, which lie in the workspace."""
    own = lambda df: df.filter(F.col("workspace_id") == WORKSPACE)
    return graph.session_edges(own(_mod(spark, sf)), own(frame(spark, sf, CLAIM)), seeds)


def _first(spark: SparkSession, sf: str) -> DataFrame:
    mod = _mod(spark, sf)
    seen = graph.visible(mod, WORKSPACE, list(SEE.domains), SEE.with_global).filter("status = 'active'")
    dense = recall.concept_hits(recall.dense_topk(_emb(spark, sf), mod, _vector(spark, sf), WORKSPACE, 8, SEE))
    return vectors.checkpointed(recall.hybrid_seed(recall.lexical_rank(seen, TEXT, 8), dense, 8).orderBy(F.desc("score"), "concept_id").limit(recall.SEEDS).select("concept_id"))


def _compact(spark: SparkSession, sf: str) -> DataFrame:
    mod = _mod(spark, sf)
    hits = recall.compact_search(mod, _emb(spark, sf), lambda seeds: _edges(spark, sf, seeds), WORKSPACE, TEXT, _vector(spark, sf), see=SEE, normal=None)
    return hits.withColumn("score", F.round("score", 6))


@query(_LEX + " SELECT concept_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM lex", *SHAPES)
def lexical_rank(spark, sf):
    seen = graph.visible(_mod(spark, sf), WORKSPACE, list(SEE.domains), SEE.with_global).filter("status = 'active'")
    return recall.lexical_rank(seen, TEXT, 8).select("concept_id", F.round("score", 6).alias("score"), "rank")


@query(_LEX + f" SELECT concept_id, round({_LEXICAL}, 6) AS score FROM m", *SHAPES)
def lexical_score(spark, sf):
    score = recall.lexical_score(F.lit(TEXT), F.col("name"), F.col("definition"), F.col("entities_json"), F.col("facts_json"))
    return _mod(spark, sf).select("concept_id", F.round(score, 6).alias("score"))


@query(_dense(10) + " SELECT source_type, source_id, round(score, 6) AS score FROM dense_all", *SHAPES)
def cosine_topk_elevated(spark, sf):
    top = recall.dense_topk(_emb(spark, sf), _mod(spark, sf), _vector(spark, sf), WORKSPACE, 10, SEE)
    return top.select("source_type", "source_id", F.round("score", 6).alias("score"))


@query(_SEED + _EDGES + _FORWARD + " SELECT concept_id, round(score, 6) AS score FROM fwd", *SHAPES)
def forward_expand(spark, sf):
    mod, first = _mod(spark, sf), _first(spark, sf)
    return recall.forward_expand(first, _edges(spark, sf, first), mod, WORKSPACE, recall.step_weight(3), SEE).select("concept_id", F.round("score", 6).alias("score"))


@query(_SEED + _REVERSE + " SELECT concept_id, round(score, 6) AS score FROM rev", *SHAPES)
def reverse_expand(spark, sf):
    return recall.reverse_expand(_first(spark, sf), _mod(spark, sf), WORKSPACE, recall.step_weight(3) * recall.REVERSE, SEE, None).select("concept_id", F.round("score", 6).alias("score"))


@query(_COMPACT + " SELECT concept_id, score, CAST(lexical_rank AS INT) AS lexical_rank, CAST(dense_rank AS INT) AS dense_rank FROM hits", *SHAPES)
def compact_search(spark, sf):
    return _compact(spark, sf).select("concept_id", "score", "lexical_rank", "dense_rank")


@query(_COMPACT + " SELECT concept_id, round(CASE WHEN dense_rank IS NULL THEN 0e0 ELSE 1e0 / (dense_rank + 1) END, 6) AS semantic_score, round(CASE WHEN lexical_rank IS NULL THEN 0e0 ELSE 1e0 / (lexical_rank + 1) END, 6) AS entity_score, 1e0 AS recency FROM hits", *SHAPES)
def pseudo_scores(spark, sf):
    found = recall.pseudo_scores(_compact(spark, sf))
    return found.select("concept_id", F.round("semantic_score", 6).alias("semantic_score"), F.round("entity_score", 6).alias("entity_score"), "recency")


_WANTED = ["red", "bolt"]
_DUAL = f""", m AS (SELECT *, from_json(entities_json, '["VARCHAR"]') AS ents FROM b_module), vis AS (SELECT * FROM m WHERE {_SEEN}){_dense(10)},
own AS (SELECT concept_id, ents FROM m WHERE workspace_id = '{WORKSPACE}' AND status = 'active' AND list_has_any(ents, {_WANTED}) ORDER BY confidence DESC, concept_id LIMIT 20),
ch AS (SELECT concept_id, score AS semantic_score, 0e0 AS entity_score FROM den UNION ALL SELECT concept_id, 0e0, CAST(len(list_intersect({_WANTED}, list_distinct(list_transform(ents, lambda e: lower(e))))) AS DOUBLE) / len(list_distinct(list_transform(ents, lambda e: lower(e)))) FROM own),
s AS (SELECT concept_id, max(semantic_score) AS semantic_score, max(entity_score) AS entity_score FROM ch GROUP BY 1),
j AS (SELECT s.*, m.status, CASE WHEN m.status IS NULL THEN 1e0 ELSE exp(-(1 / 90e0) / (1 + 0.5e0 * m.successful_recall_count) * (greatest(epoch_us(TIMESTAMP '2026-01-01 00:00:00') - epoch_us(CAST(replace(coalesce(m.last_recalled_at, m.created_at), 'Z', '') AS TIMESTAMP)), 0) / 86400e6)) END AS recency
  FROM s LEFT JOIN m USING (concept_id) WHERE m.status IS NULL OR (m.status IN ('active', 'disputed') AND concept_id IN (SELECT concept_id FROM vis)))"""


@query(_DUAL + " SELECT concept_id, round((semantic_score * 0.6e0 + entity_score * 0.4e0) * recency, 6) AS score, round(semantic_score, 6) AS semantic_score, round(entity_score, 6) AS entity_score, round(recency, 6) AS recency FROM j", *SHAPES)
def dual_channel_rank(spark, sf):
    found = recall.rank(_mod(spark, sf), _emb(spark, sf), WORKSPACE, _WANTED, _vector(spark, sf), NOW, SEE)
    return found.select("concept_id", *[F.round(c, 6).alias(c) for c in ("score", "semantic_score", "entity_score", "recency")])


@query(""" SELECT memory_id, array_to_string(list_distinct_in_order, ' ') AS entities FROM (SELECT memory_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS list_distinct_in_order FROM (
  SELECT memory_id, list_filter(list_transform(list_filter(string_split_regex(content, '[^\\p{L}\\p{N}_\\-\\x{80}-\\x{10FFFF}]+'), lambda p: len(p) >= 2), lambda p: regexp_replace(regexp_replace(lower(p), '[ _-]+', '_', 'g'), '_+$', '')), lambda x: x <> '' AND x NOT IN STOP) AS k FROM b_raw_memory))""".replace("STOP", listed(vocab.QUERY_STOPWORDS)), "b_raw_memory")
def query_entities(spark, sf):
    keys = recall.query_entities(F.col("content"))
    return frame(spark, sf, "b_raw_memory").select("memory_id", F.array_join(keys, " ").alias("entities"))


_BUDGETS = recall.section_budgets("general_query", 300)
_CONTEXT = _COMPACT + f""", top AS (SELECT concept_id, row_number() OVER (ORDER BY score DESC, concept_id) - 1 AS place FROM hits QUALIFY place < 5),
tc AS (SELECT m.*, place, from_json(facts_json, '["VARCHAR"]') AS facts, from_json(rejected_json, '["VARCHAR"]') AS rejected, from_json(questions_json, '["VARCHAR"]') AS questions FROM m JOIN top USING (concept_id)),
parts AS (SELECT 'user_preferences' AS section, place, CASE WHEN concept_type = 'preference' THEN facts ELSE [] END AS items FROM tc
  UNION ALL SELECT 'known_facts', place, list_concat(CASE WHEN coalesce(definition, '') <> '' THEN [concat(name, ': ', definition)] ELSE [] END, facts) FROM tc
  UNION ALL SELECT 'rejected_hypotheses', place, list_concat(CASE WHEN status = 'disputed' THEN [concat(name, ' is disputed')] ELSE [] END, coalesce(rejected, [])) FROM tc
  UNION ALL SELECT 'task_state', place, coalesce(questions, []) FROM tc UNION ALL SELECT 'relevant_entities', place, ents FROM tc),
items AS (SELECT section, item, min(place * 1000 + pos) AS o FROM (SELECT section, place, unnest(range(len(items))) AS pos, unnest(items) AS item FROM parts) GROUP BY 1, 2),
kept AS (SELECT section, item, o FROM (SELECT *, sum(greatest(1, ceil(length(item) / 4.0))) OVER (PARTITION BY section ORDER BY o) AS used FROM items) WHERE used <= CASE section {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _BUDGETS.items())} END),
texts AS (SELECT section, string_agg(item, '|' ORDER BY o) AS text, string_agg(concat('- ', item), chr(10) ORDER BY o) AS lines FROM kept GROUP BY 1),
one AS (SELECT (SELECT name FROM tc ORDER BY place LIMIT 1) AS current_concept, {', '.join(f"coalesce((SELECT text FROM texts WHERE section = '{s}'), '') AS {s}" for s in recall.SECTIONS)}),
prompt AS (SELECT concat('[Memory Context]', chr(10), 'Workspace: {WORKSPACE}', chr(10), 'Current Concept: ', current_concept, chr(10), 'Intent: general_query', {', '.join(f"coalesce((SELECT concat(chr(10), chr(10), '{h}:', chr(10), lines) FROM texts WHERE section = '{s}'), '')" for s, h in zip(recall.SECTIONS, recall.HEADINGS))}, chr(10), chr(10), 'Instructions:', chr(10), '{recall.INSTRUCTIONS[0]}', chr(10), '{recall.INSTRUCTIONS[1]}') AS prompt FROM one)"""


@query(_CONTEXT + " SELECT current_concept, user_preferences, known_facts, rejected_hypotheses, task_state, relevant_entities, CAST(ceil(length(prompt) / 4.0) AS BIGINT) AS token_count FROM one, prompt", *SHAPES)
def memory_context(spark, sf):
    mod = _mod(spark, sf)
    best = recall.best_concepts(_compact(spark, sf), mod)
    found = recall.build_context(best, WORKSPACE, "general_query", 300)
    return found.select("current_concept", *[F.array_join(s, "|").alias(s) for s in recall.SECTIONS], "token_count")


@query(_COMPACT + " SELECT concept_id FROM hits WHERE concept_id IN (SELECT concept_id FROM m) ORDER BY score DESC, concept_id LIMIT 3", *SHAPES)
def recalled_concepts(spark, sf):
    return recall.recalled(recall.best_concepts(_compact(spark, sf), _mod(spark, sf)))


_PCT = {s: " ".join(f"WHEN '{i}' THEN {p[k]}" for i, p in vocab.INTENT_BUDGETS.items()) for k, s in enumerate(recall.SECTIONS)}


@query(" SELECT intent, most, " + ", ".join(f"CAST(greatest(greatest(most - 250, 0), most // 2) * CASE intent {_PCT[s]} END // 100 AS BIGINT) AS {s}" for s in recall.SECTIONS) + " FROM (SELECT unnest(" + str(list(vocab.INTENT_BUDGETS)) + ") AS intent), (SELECT unnest([100, 300, 1500, 4001]) AS most)")
def recall_budgets(spark, sf):
    rows = [(i, m, *recall.section_budgets(i, m).values()) for i in vocab.INTENT_BUDGETS for m in (100, 300, 1500, 4001)]
    return spark.createDataFrame(rows, "intent string, most int, " + ", ".join(f"{s} long" for s in recall.SECTIONS))
