"""Registered queries of ingestion and planning. Session files are written from the conversations and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import planner, store
from corrolith.plans.bridge import frame
from corrolith.plans.registry import listed, query
from corrolith.sources import sessions

LIVE = f"status NOT IN {listed(vocab.DEAD)}"
NOW = "2026-01-01T00:00:00Z"


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def _turns(df: DataFrame, *fields) -> DataFrame:
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *fields))).alias("turns"))


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON session file for each conversation; odd ones have a date."""
    turns = _turns(_talks(spark, sf), "role", F.col("text").alias("content"))
    date = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("2025-0"), F.col("conv_id") % 9 + 1, F.lit("-01")))
    body = F.to_json(F.struct(F.concat(F.lit("s-"), "conv_id").alias("session_id"), date.alias("date"), F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("messages")))
    return turns.select(F.concat(F.lit("f-"), "conv_id").alias("source_ref"), F.concat(F.lit("ws-"), F.col("conv_id") % 4).alias("workspace_id"), body.alias("content"))


def _line(text):
    return F.concat(F.lit("said "), F.translate(text, "\r\n", "  "))


def journal_files(spark: SparkSession, sf: str) -> DataFrame:
    """A journal for each conversation: a session with a section for each turn."""
    turns = _turns(_talks(spark, sf), "role", _line(F.col("text")).alias("line"))
    parts = F.transform("turns", lambda t: F.concat(F.lit("### Turn "), t.turn.cast("string"), F.lit(" "), t.role, F.lit("\n"), t.line, F.lit("\n\n")))
    body = F.concat(F.lit("# Journal\nbefore any session\n\n## Session "), "conv_id", F.lit(": talk\n**Date**: 2025-06-0"), F.col("conv_id") % 9 + 1, F.lit("\n\n### Empty\n\n"), F.array_join(parts, ""), F.lit("---\n\n## Session of "), "conv_id", F.lit("\nlast words\n"))
    return turns.select(F.concat(F.lit("j-"), "conv_id").alias("source_ref"), F.concat(F.lit("ws-"), F.col("conv_id") % 4).alias("workspace_id"), body.alias("content"))


_SHOWN = ("workspace_id", "session_id", "role", "content", "source_type", "source_ref", "created_at")
_JSON = "SELECT concat('ws-', conv_id % 4) AS workspace_id, concat('s-', conv_id) AS session_id, role, text AS content, 'session_file' AS source_type, concat('f-', conv_id) AS source_ref, CASE WHEN conv_id % 2 = 1 THEN concat('2025-0', conv_id % 9 + 1, '-01') ELSE '2026-01-01T00:00:00Z' END AS created_at FROM conversations"
_JOURNAL = r"""SELECT concat('ws-', conv_id % 4) AS workspace_id, concat('session_', conv_id) AS session_id, concat('turn ', turn, ' ', lower(role)) AS role, regexp_replace(concat('said ', translate(text, chr(13) || chr(10), '  ')), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS content, 'journal' AS source_type, concat('j-', conv_id) AS source_ref, concat('2025-06-0', conv_id % 9 + 1) AS created_at FROM conversations
UNION ALL SELECT DISTINCT concat('ws-', conv_id % 4), concat('session_', conv_id), 'header', concat('Session ', conv_id, ': talk', chr(10), '**Date**: 2025-06-0', conv_id % 9 + 1), 'journal', concat('j-', conv_id), concat('2025-06-0', conv_id % 9 + 1) FROM conversations
UNION ALL SELECT DISTINCT concat('ws-', conv_id % 4), concat('Session of ', conv_id), 'header', concat('Session of ', conv_id, chr(10), 'last words'), 'journal', concat('j-', conv_id), '2026-01-01T00:00:00Z' FROM conversations"""


@query(_JSON)
def json_sessions(spark, sf):
    return sessions.json_sessions(json_files(spark, sf), NOW).select(*_SHOWN)


@query(_JOURNAL)
def journal_sections(spark, sf):
    return sessions.journal_sections(journal_files(spark, sf), NOW).select(*_SHOWN)


def _mixed_files(spark, sf) -> DataFrame:
    other = _talks(spark, sf).select(F.concat(F.lit("t-"), "conv_id", F.lit("-"), "turn").alias("source_ref"), F.lit("ws-0").alias("workspace_id"), F.concat(F.lit("text "), "text").alias("content"))
    return json_files(spark, sf).unionByName(journal_files(spark, sf)).unionByName(other)


@query(f"SELECT source_type, count(*) AS n FROM ({_JSON} UNION ALL {_JOURNAL}) GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM conversations")
def session_dispatch(spark, sf):
    rows, unknown = sessions.parse_sessions(_mixed_files(spark, sf), NOW)
    return rows.select("source_type").union(unknown.select(F.lit("unknown").alias("source_type"))).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT memory_id, min(content) AS content FROM (SELECT memory_id, content FROM b_raw_memory UNION ALL SELECT memory_id, concat(content, ' again') FROM b_raw_memory) WHERE memory_id NOT IN (SELECT memory_id FROM b_raw_memory WHERE session_id IN ('s-1', 's-2', 's-3')) GROUP BY 1", "b_raw_memory")
def raw_dedup(spark, sf):
    raw = frame(spark, sf, "b_raw_memory").select("memory_id", "session_id", "content")
    twice = raw.union(raw.withColumn("content", F.concat("content", F.lit(" again"))))
    return store.insert_or_ignore(twice, raw.filter("session_id IN ('s-1', 's-2', 's-3')"), ["memory_id"], ["content"]).select("memory_id", "content")


_CLAIMS = "SELECT concat('e-', conv_id, '-', turn) AS id, concat('ws-', conv_id % 4) AS workspace_id, concat('s-', conv_id) AS session_id, CASE WHEN turn % 3 = 0 THEN substr(text, 3, 15) WHEN turn % 3 = 1 THEN concat(substr(text, 1, 5), '#', substr(text, 9, 4)) ELSE '' END AS evidence_text FROM {conversations}"


@query(f"WITH c AS ({_CLAIMS.format(conversations='conversations')}), r AS (SELECT concat('s-', conv_id) AS session_id, text FROM conversations) SELECT id, evidence_text FROM c WHERE evidence_text <> '' AND EXISTS (SELECT 1 FROM r WHERE r.session_id = c.session_id AND contains(r.text, c.evidence_text))")
def evidence_gate(spark, sf):
    claims = spark.sql(_CLAIMS, conversations=_talks(spark, sf))
    return planner.supported(claims, frame(spark, sf, "b_raw_memory")).select("id", "evidence_text")


_PLAN = f""", l AS (SELECT DISTINCT workspace_id, subject_text, predicate, object_text FROM b_known WHERE {LIVE})
SELECT observation_id, CASE WHEN trim(subject_text) = '' OR (trim(evidence_text) = '' AND source_type = 'assistant_guess') THEN 'skip'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.workspace_id = n.workspace_id AND l.subject_text = n.subject_text AND l.predicate = n.predicate AND l.object_text IS NOT DISTINCT FROM n.object_text) THEN 'reinforce'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.workspace_id = n.workspace_id AND l.subject_text = n.subject_text AND l.predicate = n.predicate) THEN 'update'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.workspace_id = n.workspace_id AND l.subject_text = n.subject_text AND l.object_text IS NOT DISTINCT FROM n.object_text) THEN 'merge' ELSE 'add' END AS action FROM b_new n"""


@query(_PLAN, "b_known", "b_new")
def action_plan(spark, sf):
    return planner.plan(frame(spark, sf, "b_new"), frame(spark, sf, "b_known"), None).select("observation_id", "action")


@query(None)
def action_effects(spark, sf):
    new = frame(spark, sf, "b_new").withColumn("place", F.col("observation_id"))
    return planner.apply_plan(new, frame(spark, sf, "b_known")).select("candidate_id", "action", "target_id")


@query(""", s AS (SELECT memory_id FROM b_order_memory WHERE session_id LIKE 'so-%3')
SELECT observation_id, CASE WHEN memory_id IN (SELECT memory_id FROM s) THEN 'superseded' ELSE status END AS status, CASE WHEN memory_id IN (SELECT memory_id FROM s) AND status <> 'superseded' THEN 'batch-2' END AS superseded_by FROM b_observation""", "b_observation", "b_order_memory")
def reextract_supersede(spark, sf):
    raw = frame(spark, sf, "b_order_memory")
    sessions_ = raw.filter("session_id LIKE 'so-%3'").select("workspace_id", "session_id").distinct().withColumn("batch_id", F.lit("batch-2"))
    return planner.superseded_sessions(frame(spark, sf, "b_observation"), raw, sessions_).select("observation_id", "status", "superseded_by")


@query(" SELECT session_id, concat('Input messages:', chr(10), string_agg(concat('[', role, ']: ', content), chr(10) ORDER BY seq), chr(10), chr(10), 'Output:') AS prompt FROM b_raw_memory GROUP BY 1", "b_raw_memory")
def session_prompts(spark, sf):
    return planner.prompts(frame(spark, sf, "b_raw_memory"), ["seq"]).select("session_id", "prompt")


_REPLY = "concat(CASE turn % 3 WHEN 0 THEN concat('```json', chr(10)) WHEN 1 THEN '```' ELSE ' ' END, '{\"n\":', conv_id, '}', CASE WHEN turn % 3 < 2 THEN concat(chr(10), '```') ELSE ' ' END)"


@query("SELECT conv_id, turn, concat('{\"n\":', conv_id, '}') AS reply FROM conversations")
def reply_without_fences(spark, sf):
    return _talks(spark, sf).select("conv_id", "turn", S.without_fences(F.expr(_REPLY)).alias("reply"))


@query(" SELECT session_id, min(seq) AS first_seq, count(*) AS n, string_agg(memory_id, ' ' ORDER BY seq) AS memories FROM b_raw_memory WHERE session_id = 's-1' GROUP BY 1", "b_raw_memory")
def raw_by_session(spark, sf):
    rows = frame(spark, sf, "b_raw_memory").filter("session_id = 's-1'")
    listed_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "memory_id"))), lambda x: x["memory_id"]), " ")
    return rows.groupBy("session_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), listed_.alias("memories"))


@query(" SELECT memory_id, seq FROM b_raw_memory WHERE workspace_id = 'ws-1' ORDER BY seq DESC, memory_id LIMIT 50", "b_raw_memory")
def raw_window(spark, sf):
    return store.listing_order(frame(spark, sf, "b_raw_memory").filter("workspace_id = 'ws-1'").select("memory_id", "seq"), F.desc("seq"), "memory_id").limit(50)
