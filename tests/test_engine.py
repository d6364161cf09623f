"""Engine queries against their SQL, and operators on small fixtures."""

import compare
import pytest
from pyspark.sql import functions as F

from corrolith.functions import scalars as S
from corrolith.operators import graph, history, ledger, vectors
from corrolith.plans import queries as Q
from corrolith.plans.bridge import with_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs_where_sql_cannot_tell(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    assert compare.rows_of_spark(Q.queries()[name](spark, SF)) == compare.rows_of_sql(Q.oracle_sql()[name], SF)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,key", [("  Foo Bar--baz_ ", "foo_bar_baz"), ("ＡＢＣ", "abc"), ("_lead__", "_lead"), ("", ""), (None, None)])
def test_entity_key(spark, text, key):
    assert one(spark, text, S.key_light) == key


@pytest.mark.parametrize("text,kind", [("I know it", "general"), ("no.", "negate"), ("针对", "general"), ("还有一个", "supplement"), ("It should be 5", "correct"), ("yes", "confirm"), ("不对，对", "negate")])
def test_feedback_class(spark, text, kind):
    assert one(spark, text, S.feedback_class) == kind


@pytest.mark.parametrize("text,key", [("Leads To", "causes"), (" lacks", "not_has"), ("Sings With", "sings_with"), (None, None)])
def test_predicate_key(spark, text, key):
    assert one(spark, text, S.predicate_key) == key


def test_null_objects_count_as_one_triple(spark):
    rows = [("a", "w1", "s", "has", None, "confirmed"), ("b", "w2", "s", "has", None, "disputed"), ("c", "w3", "s", "has", None, "rejected")]
    df = spark.createDataFrame(rows, "observation_id string, workspace_id string, subject_text string, predicate string, object_text string, status string")
    assert {(r.observation_id, r.cross_project_count) for r in ledger.cross_workspace_count(df).collect()} == {("a", 2), ("b", 2)}


def test_lifecycle_is_reached_at_a_prefix(spark):
    events = [("w", "a", "b", "shared_entity", e, i) for i, e in enumerate(["repeated_occurrence"] * 3 + ["user_negation"])]
    df = spark.createDataFrame(events, "workspace_id string, src string, dst string, relation_type string, evidence string, seq int")
    r = graph.fold_edges_ordered(df, ["seq"]).first()
    assert (r.alpha, r.beta, r.evidence_count, r.lifecycle) == (4.0, 4.0, 4, "validated")
    assert graph.fold_edges(df).first().lifecycle == "candidate"


def test_alias_chain_and_self_pointer(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "e")], "alias_concept_id string, primary_concept_id string")
    assert dict(graph.aliases(df).collect()) == {"b": "a", "c": "a", "d": "a", "e": "e"}


def test_as_of(spark):
    df = spark.createDataFrame([("w", "x", "p", "1", 1, 10), ("w", "x", "p", "2", 2, 20)], "workspace_id string, entity string, property string, value string, seq int, valid_from int")
    assert [[r.value for r in history.as_of(df, t).collect()] for t in (5, 10, 19, 20)] == [[], ["1"], ["1"], ["2"]]


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"))
    pairs = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in vectors.components(nodes, pairs).collect()} == {0}


def test_unknown_status_is_an_error(spark):
    with pytest.raises(ValueError):
        ledger.by_status(spark.range(1), "w", "nonsense")


def test_peers_share_any_related_entity(spark):
    sql = f"{with_sql(Q.CON)}{Q.IDX} SELECT a.concept_id, b.concept_id AS peer_id, count(*) AS overlap FROM i a JOIN i b ON a.entity = b.entity AND a.workspace_id <> b.workspace_id WHERE b.concept_id IN (SELECT concept_id FROM b_concept WHERE lifecycle_scope = 'project') GROUP BY 1, 2"
    names, rows = compare.rows_of_spark(Q.cross_workspace_peers(spark, SF))
    assert (names, rows) == compare.rows_of_sql(sql, SF) and max(r[1] for r in rows) >= 2


def test_batch_edges_read_all_strictly_live_claims(spark):
    sql = with_sql(Q.CON, "b_claim") + Q._BATCH.replace("b_cause o JOIN", f"(SELECT * FROM b_claim WHERE {Q.STRICT}) o JOIN") + Q._fold("ba")
    names, rows = compare.rows_of_spark(Q.batch_edges(spark, SF))
    assert (names, rows) == compare.rows_of_sql(sql, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert set(Q.frame(spark, SF, "b_claim").groupBy("extraction_batch_id", "status").count().collect()) == set(Q.frame(spark, SF, Q.OBS).groupBy("extraction_batch_id", "status").count().collect())
    assert Q.frame(spark, SF, "b_claim").count() == lines.count() and sum(rows.values()) > 0


def test_causes_edges_fold_in_order(spark):
    causes = Q._CAUSES.replace("b_cause o", "b_cause_timed o").replace(" AS evidence\n", " AS evidence, created_ts, observation_id\n")
    sql = with_sql(Q.CON, "b_cause_timed") + causes + Q._fold_ordered("ca", "created_ts DESC, observation_id, evidence")
    assert compare.rows_of_spark(Q.causes_edges(spark, SF)) == compare.rows_of_sql(sql, SF)


def test_causes_validated_before_a_later_negation(spark):
    con = spark.createDataFrame([("w", "a", "active", ["x"]), ("w", "b", "active", ["y"])], "workspace_id string, concept_id string, status string, related_entities array<string>")
    rows = [("w", f"o{i}", "x", "causes", "y", s, "confirmed", i) for i, s in enumerate(["user_negation"] + ["user_message"] * 3)]
    obs = spark.createDataFrame(rows, "workspace_id string, observation_id string, subject_text string, predicate string, object_text string, source_type string, status string, created_ts int")
    assert graph.fold_edges_ordered(graph.causes_events(con, obs), Q.newest()).first().lifecycle == "validated"
