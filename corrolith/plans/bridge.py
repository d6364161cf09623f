"""The given tables in the shapes that the operators read. Each statement is portable: Spark and another SQL engine agree on it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith.operators.vectors import sorted_in_joins

BRIDGE = {
    "b_raw_memory": """
SELECT concat('m-', conv_id, '-', turn) AS memory_id, concat('ws-', conv_id % 4) AS workspace_id,
       concat('s-', conv_id) AS session_id, role, text AS content,
       'session_file' AS source_type, 'conversations' AS source_ref,
       CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('v', conv_id % 3) END AS extraction_version,
       turn AS seq
FROM {conversations}
""",
    "b_observation": """
SELECT concat('o-', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS observation_id,
       concat('ws-', l_suppkey % 5) AS workspace_id, concat('m-', l_orderkey) AS memory_id,
       replace(p_name, ' ', '_') AS subject_text,
       CASE l_linenumber WHEN 1 THEN 'has' WHEN 2 THEN 'not_has' WHEN 3 THEN 'depends_on' WHEN 4 THEN 'not_depends_on'
            WHEN 5 THEN 'related_to' WHEN 6 THEN 'not_related_to' ELSE 'causes' END AS predicate,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE lower(p_brand) END AS object_text,
       CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'user_message' WHEN 'RF' THEN 'user_confirm' WHEN 'AO' THEN 'user_negation'
            WHEN 'AF' THEN 'file_evidence' ELSE 'assistant_guess' END AS source_type,
       CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 0.7e0 WHEN 'RF' THEN 0.85e0 WHEN 'AO' THEN 0.8e0
            WHEN 'AF' THEN 0.9e0 ELSE 0.3e0 END AS extraction_confidence,
       1e0 + CAST(l_quantity AS INT) % 5 AS evidence_alpha, 1e0 + CAST(l_quantity AS INT) % 3 AS evidence_beta,
       CASE WHEN l_orderkey % 10 <= 3 THEN 'candidate' WHEN l_orderkey % 10 <= 5 THEN 'confirmed' WHEN l_orderkey % 10 = 6 THEN 'auto_confirmed'
            WHEN l_orderkey % 10 = 7 THEN 'disputed' WHEN l_orderkey % 10 = 8 THEN 'superseded' ELSE 'rejected' END AS status,
       concat('b-', l_orderkey) AS extraction_batch_id, l_shipdate AS created_ts
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""",
    "b_concept": """
SELECT concat(replace(p_name, ' ', '_'), '@', lower(p_brand)) AS narrow, p_name, concat('c-', p_partkey) AS concept_id, concat('ws-', p_partkey % 5) AS workspace_id, p_name AS name,
       concat(lower(p_type), ' ', p_name) AS definition,
       split_part(p_name, ' ', 1) AS entity_1, split_part(p_name, ' ', 2) AS entity_2, lower(p_brand) AS entity_3,
       1e0 + p_size % 7 AS evidence_alpha, 1e0 + p_size % 3 AS evidence_beta,
       (1e0 + p_size % 7) / ((1e0 + p_size % 7) + (1e0 + p_size % 3)) AS confidence,
       CASE WHEN p_size % 10 <= 6 THEN 'active' WHEN p_size % 10 = 7 THEN 'disputed' WHEN p_size % 10 = 8 THEN 'deprecated' ELSE 'candidate' END AS status,
       CASE WHEN p_partkey % 20 = 0 THEN 'global' WHEN p_partkey % 20 = 1 THEN 'domain' ELSE 'project' END AS lifecycle_scope,
       CASE WHEN p_partkey % 20 = 1 THEN lower(p_type) ELSE NULL END AS scope_key,
       p_size % 6 AS recall_count, p_size % 3 AS successful_recall_count, p_partkey % 4 AS connection_count
FROM {part}
""",
    "b_embedding": """
SELECT CASE vec_id % 3 WHEN 0 THEN 'observation' ELSE 'concept' END AS source_type, concat(CASE vec_id % 3 WHEN 0 THEN 'v-' ELSE 'c-' END, vec_id) AS source_id,
       concat('ws-', vec_id % 5) AS workspace_id, embedding AS vector, label
FROM {embeddings}
""",
    "b_feedback_events": """
SELECT event_id, concat('c-', user_id) AS concept_id, ts,
       CASE WHEN event_id % 11 = 0 THEN 'it should be utf-8'
            WHEN event_type = 'click' THEN 'yes, right' WHEN event_type = 'view' THEN 'also see the index'
            WHEN event_type = 'purchase' THEN 'i like this layout' WHEN event_type = 'error' THEN 'that is wrong'
            ELSE 'this time only, please' END AS feedback_text
FROM {events}
""",
    "b_timeline_events": """
SELECT o_orderkey AS seq, concat('ws-', o_custkey % 4) AS workspace_id, concat('cust-', o_custkey) AS entity,
       lower(o_orderpriority) AS property, o_orderstatus AS value, o_orderdate AS valid_from
FROM {orders}
""",
    "b_cause": """
SELECT concat('o-', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS observation_id, concat('ws-', p.p_partkey % 5) AS workspace_id,
       concat(replace(p.p_name, ' ', '_'), '@', lower(p.p_brand)) AS subject_text, 'causes' AS predicate,
       concat(replace(q.p_name, ' ', '_'), '@', lower(q.p_brand)) AS object_text, concat('b-', l_orderkey) AS extraction_batch_id,
       CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'user_message' WHEN 'RF' THEN 'user_confirm' WHEN 'AO' THEN 'user_negation'
            WHEN 'AF' THEN 'file_evidence' ELSE 'assistant_guess' END AS source_type, 'confirmed' AS status
FROM {lineitem} JOIN {part} p ON l_partkey = p.p_partkey JOIN {part} q ON l_suppkey = q.p_partkey
WHERE l_linenumber = 7
""",
}
# The same with its time, by which evidence is folded in order.
BRIDGE["b_cause_timed"] = BRIDGE["b_cause"].replace("'confirmed' AS status", "'confirmed' AS status, l_shipdate AS created_ts")
# Each line item as an observation about a concept, with the status of b_observation.
BRIDGE["b_claim"] = """
SELECT concat('ws-', p_partkey % 5) AS workspace_id, concat(replace(p_name, ' ', '_'), '@', lower(p_brand)) AS subject_text, concat('b-', l_orderkey) AS extraction_batch_id,
       CASE WHEN l_orderkey % 10 <= 3 THEN 'candidate' WHEN l_orderkey % 10 <= 5 THEN 'confirmed' WHEN l_orderkey % 10 = 6 THEN 'auto_confirmed'
            WHEN l_orderkey % 10 = 7 THEN 'disputed' WHEN l_orderkey % 10 = 8 THEN 'superseded' ELSE 'rejected' END AS status
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
# A concept with all that recall reads; lists are serialised as they are stored.
BRIDGE["b_module"] = """
SELECT concat('c-', p_partkey) AS concept_id, concat('ws-', p_partkey % 5) AS workspace_id, p_name AS name,
       CASE p_size % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'bug_fix' ELSE NULL END AS concept_type,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(lower(p_type), ' ', p_name) END AS definition,
       concat('["', replace(p_name, ' ', '_'), '@', lower(p_brand), '","', split_part(p_name, ' ', 1), '","', split_part(p_name, ' ', 2), '","', lower(p_brand), '"]') AS entities_json,
       concat('["fits ', lower(p_brand), '","size ', p_size, '"]') AS facts_json,
       CASE WHEN p_size % 4 = 0 THEN concat('["not ', lower(p_type), '"]') ELSE NULL END AS rejected_json,
       CASE WHEN p_size % 3 = 0 THEN concat('["why ', p_name, '","which size"]') ELSE NULL END AS questions_json,
       1e0 + p_size % 7 AS evidence_alpha, 1e0 + p_size % 3 AS evidence_beta,
       (1e0 + p_size % 7) / ((1e0 + p_size % 7) + (1e0 + p_size % 3)) AS confidence,
       CASE WHEN p_size % 10 <= 6 THEN 'active' WHEN p_size % 10 = 7 THEN 'disputed' WHEN p_size % 10 = 8 THEN 'deprecated' ELSE 'candidate' END AS status,
       CASE WHEN p_partkey % 20 = 0 THEN 'global' WHEN p_partkey % 20 = 1 THEN 'domain' ELSE 'project' END AS lifecycle_scope,
       CASE WHEN p_partkey % 20 = 1 THEN lower(p_type) ELSE NULL END AS scope_key,
       p_size % 6 AS recall_count, p_size % 3 AS successful_recall_count, p_partkey % 4 AS connection_count,
       concat('2025-0', 1 + p_partkey % 9, '-1', p_partkey % 10, 'T00:00:00Z') AS created_at,
       CASE WHEN p_size % 6 = 0 THEN NULL ELSE concat('2025-1', p_partkey % 3, '-0', 1 + p_size % 9, 'T00:00:00Z') END AS last_recalled_at
FROM {part}
"""
# Messages of customers, to which the observations of their orders go back.
BRIDGE["b_order_memory"] = """
SELECT concat('m-', o_orderkey) AS memory_id, concat('ws-', o_custkey % 5) AS workspace_id, concat('so-', o_custkey) AS session_id, 'user' AS role, o_orderstatus AS content
FROM {orders}
"""
# What is known, and what newly extracted candidates say about the same subjects.
BRIDGE["b_known"] = """
SELECT concat('k-', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS observation_id, concat('ws-', p_partkey % 5) AS workspace_id,
       concat(replace(p_name, ' ', '_'), '@', lower(p_brand)) AS subject_text, concat('rel_', l_orderkey % 60) AS predicate, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('q', CAST(l_quantity AS INT) % 20) END AS object_text,
       CASE WHEN l_orderkey % 10 <= 6 THEN 'confirmed' WHEN l_orderkey % 10 = 7 THEN 'disputed' WHEN l_orderkey % 10 = 8 THEN 'superseded' ELSE 'rejected' END AS status, 1e0 AS evidence_alpha, l_shipdate AS created_ts
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
BRIDGE["b_new"] = """
SELECT concat('n-', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS observation_id, concat('ws-', p_partkey % 5) AS workspace_id,
       CASE WHEN l_orderkey % 31 = 0 THEN ' ' ELSE concat(replace(p_name, ' ', '_'), '@', lower(p_brand)) END AS subject_text, concat('rel_', (l_orderkey + 7 * l_linenumber) % 60) AS predicate, concat('q', CAST(l_quantity AS INT) % 20) AS object_text,
       CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE 'said so' END AS evidence_text, CASE l_returnflag WHEN 'R' THEN 'assistant_guess' ELSE 'user_message' END AS source_type
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
# Observations with their vectors.
BRIDGE["b_item"] = """
SELECT concat('v-', vec_id) AS observation_id, concat('ws-', vec_id % 5) AS workspace_id, concat('topic ', label) AS subject_text, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE concat('thing ', vec_id % 7) END AS object_text,
       concat('m-', vec_id % 50) AS memory_id, CASE WHEN vec_id % 6 = 0 THEN concat('b-', vec_id % 30) ELSE NULL END AS extraction_batch_id, 0.5e0 + (vec_id % 5) / 10e0 AS extraction_confidence,
       1e0 + vec_id % 4 AS evidence_alpha, 1e0 + vec_id % 3 AS evidence_beta, vec_id AS created_ts, embedding AS vector
FROM {embeddings}
"""
# Concept candidates with overlapping terms.
BRIDGE["b_candidate"] = """
SELECT concat('cand-', p_partkey) AS candidate_id, concat('ws-', p_partkey % 5) AS workspace_id, p_name AS name, p_partkey AS place,
       concat(split_part(p_name, ' ', 1), ';', split_part(p_name, ' ', 2), ';', lower(p_brand), ';', lower(p_type), ';size ', p_size % 3) AS terms, concat('m-', p_partkey % 40) AS sessions,
       concat('o-', p_partkey, ';o-', p_partkey % 97) AS observations, concat('fits ', lower(p_brand), ';is ', p_name) AS facts, 2 + p_size % 4 AS evidence_count, 1e0 + p_size % 7 AS evidence_alpha, 1e0 + p_size % 3 AS evidence_beta,
       p_size % 6 AS recall_count, p_size % 3 AS successful_recall_count, p_size % 2 AS failed_recall_count
FROM {part}
"""
#: Columns that hold lists, as text with semicolons between the items.
SPLIT = {"b_candidate": {"source_terms": "terms", "source_sessions": "sessions", "source_observations": "observations", "known_facts": "facts"}}
LISTS = {"b_module": {"related_entities": "entities_json", "known_facts": "facts_json", "rejected_hypotheses": "rejected_json", "open_questions": "questions_json"}}
TABLES = {name: sorted(set(re.findall(r"{(\w+)}", sql))) for name, sql in BRIDGE.items()}


def frame(spark: SparkSession, sf_dir: str, name: str, large: bool = False) -> DataFrame:
    """One of the shapes above over the tables of sf_dir; large: none of them is to be sent whole to the executors."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    out = spark.sql(BRIDGE[name], **({t: sorted_in_joins(df) for t, df in tables.items()} if large else tables))
    out = out.withColumns({k: F.from_json(v, "array<string>") for k, v in LISTS.get(name, {}).items()})
    out = out.withColumns({k: F.split(v, ";") for k, v in SPLIT.get(name, {}).items()})
    return out.withColumn("related_entities", F.array("narrow", "entity_1", "entity_2", "entity_3")) if name == "b_concept" else out


def with_sql(*names: str) -> str:
    """The shapes as a WITH clause over views named as the tables."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({BRIDGE[n].strip().format(**{t: t for t in TABLES[n]})})" for n in names)
