"""The store, its command line, providers, schemas and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrolith import cli, config, schemas, streaming
from corrolith.operators import graph, store
from corrolith.sources import bundles, providers
from corrolith.store import MemoryStore

NOW = "2026-01-01T00:00:00Z"
BUNDLE = {
    "observations": [{"id": "1", "subject": "disk", "predicate": "causes", "object": "crash", "evidence": "a full disk crashes it"}, {"id": "2", "subject": "disk", "predicate": "has", "evidence": "x", "source": "user_negation"}],
    "concepts": [{"id": "c1", "name": "disk space", "definition": "room on a disk", "entities": ["disk"]}, {"id": "c2", "name": "crash", "entities": ["crash", "disk"], "lifecycle_scope": "odd", "confidence": 0.5}],
    "relations": [{"src": "c2", "dst": "c1"}, {"src": "c2", "dst": "c1", "relation_type": "temporal"}, {"src": "c1", "dst": "c1"}],
}


@pytest.fixture()
def memory(spark, tmp_path):
    (tmp_path / "bundles").mkdir()
    (tmp_path / "bundles" / "a.json").write_text(json.dumps(BUNDLE))
    m = MemoryStore(spark, str(tmp_path / "store"))
    m.init()
    m.seed(str(tmp_path / "bundles"), NOW)
    return m


def test_seed_is_idempotent_but_for_the_timeline(memory, tmp_path):
    before = {t: memory.table(t).count() for t in schemas.SCHEMAS}
    assert (before["observation"], before["concept"], before["concept_relation"], before["raw_memory"]) == (2, 2, 2, 2)
    memory.seed(str(tmp_path / "bundles"), "2026-01-02T00:00:00Z")
    after = {t: memory.table(t).count() for t in schemas.SCHEMAS}
    assert after.pop("timeline") == before.pop("timeline") + 2 and after == before
    edges = {(r.src, r.dst, r.relation_type) for r in memory.table("concept_relation").collect()}
    assert edges == {("c1", "c2", "shared_entity"), ("c2", "c1", "temporal")}
    neg = memory.table("observation").filter("observation_id = 'obs-2'").first()
    assert (neg.evidence_alpha, neg.evidence_beta, neg.extraction_confidence) == (2.5, 4.0, 0.8)


def test_bundle_that_is_none_is_an_error(spark):
    files = spark.createDataFrame([("f", "[1]")], "source_ref string, content string")
    with pytest.raises(Exception, match="no seed bundle"):
        bundles.parsed(files).concepts.collect()


def test_verbs(memory, spark, tmp_path):
    def said(*args):
        out = []
        code = cli.run(cli.parser().parse_args(["--root", memory.root, *args]), spark, out.append, config.Settings())
        return code, "\n".join(map(str, out))

    (tmp_path / "s.json").write_text(json.dumps({"session_id": "s-1", "messages": [{"role": "user", "content": "hello"}]}))
    (tmp_path / "x.txt").write_text("what is this")
    assert said("ingest-session", str(tmp_path / "s.json")) == (0, "")
    assert said("ingest-session", str(tmp_path / "x.txt"))[0] == 1
    assert memory.table("raw_memory").filter("session_id = 's-1'").count() == 1
    assert "disk causes crash" in said("list-observations", "--status", "confirmed")[1]
    assert "disk space" in said("list-concepts")[1]
    assert "merged=0" in said("consolidate")[1]
    code, prompt = said("recall-compact", "disk")
    assert code == 0 and prompt.startswith("[Memory Context]") and "[compact] c" in memory.recall("disk", "default", providers.StubEmbedding(), NOW).first().relevant_entities[-1]
    assert memory.table("concept").filter("concept_id = 'c1'").first().recall_count >= 2
    said("feedback", "c1", "that is wrong", "--observation", "obs-1")
    one = memory.table("concept").filter("concept_id = 'c1'").first()
    assert (one.evidence_beta, one.rejected_hypotheses, one.confidence) == (4.0, ["that is wrong"], 5 / 9)
    assert memory.table("observation").filter("observation_id = 'obs-1'").first().evidence_beta == 4.0
    assert memory.table("feedback").count() == 1 and "causes=crash [active]" in said("timeline", "entity", "disk")[1]
    assert said("extract")[0] == 2 and said("transfer", "c1")[0] == 0
    with pytest.raises(store.MissingKey):
        memory.feedback("nobody", "yes", "default", NOW)


def test_extraction_into_the_store(memory, spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"session_id": "s-2", "messages": [{"role": "user", "content": "the disk has holes"}]}))
    memory.ingest(str(tmp_path / "s.json"), "default", NOW)
    reply = {"observations": [{"subject_text": "Disk", "predicate": "contains", "object_text": "Holes", "evidence_text": "has holes", "source_type": "user_message"}, {"subject_text": "disk", "predicate": "has", "evidence_text": "never said", "source_type": "x"}]}
    llm = providers.MockLlm({"holes": "```json\n" + json.dumps(reply) + "\n```"})
    effects = {r.action for r in memory.extract("default", llm, NOW, "s-2").collect()}
    assert effects == {"update"}  # the disk had nothing, by the seed
    rows = {(r.subject_text, r.predicate, r.object_text, r.status) for r in memory.table("observation").filter("subject_text = 'disk' AND predicate = 'has'").collect()}
    assert rows == {("disk", "has", None, "superseded"), ("disk", "has", "holes", "candidate")}


def test_older_layouts_are_migrated(spark):
    old = spark.createDataFrame([("o", "w", "s")], "observation_id string, workspace_id string, subject_text string")
    r = schemas.migrated(old, "observation", 1).first()
    assert (r.cross_project_count, r.consolidated, r.status) == (1, False, None)
    with pytest.raises(ValueError):
        schemas.migrated(old, "observation", schemas.VERSION + 1)


def test_a_duplicate_key_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert store.append_strict(df, df.limit(0), "k").count() == 2
    for rows in (df, df.limit(1)):
        with pytest.raises(store.DuplicateKey):
            store.append_strict(rows, df, "k")
    with pytest.raises(store.DuplicateKey):
        store.append_strict(df.union(df), df.limit(0), "k")


def test_updates_and_upserts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert dict(store.update(df, spark.createDataFrame([("a", None)], "k string, v int"), "k", ["v"]).collect()) == {"a": None, "b": 2}
    with pytest.raises(store.MissingKey):
        store.update(df, spark.createDataFrame([("z", 1)], "k string, v int"), "k", ["v"])
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert dict(store.upsert(new, df, ["k"], ["v"]).collect()) == {"a": 1, "b": 4, "c": 5}


def test_edges_begin_in_stored_order(spark):
    pairs = spark.createDataFrame([("w", "b", "a", "shared_entity"), ("w", "b", "a", "temporal")], "workspace_id string, a string, b string, relation_type string")
    assert {(r.src, r.dst, r.alpha, r.lifecycle) for r in store.new_edges(pairs, NOW).collect()} == {("a", "b", 1.0, "candidate"), ("b", "a", 1.0, "candidate")}
    for bad in (("w", "a", "a", "temporal"), ("w", "a", "b", "causal")):
        with pytest.raises(ValueError):
            store.new_edges(spark.createDataFrame([bad], pairs.schema), NOW)


def test_providers():
    stub = providers.StubEmbedding(4)
    v = stub.embed("ab")
    state, want = 0xCBF29CE484222325, np.zeros(4)
    for b in b"ab":
        state = ((state ^ b) * 0x100000001B3) % 2**64
        want[state % 4] += 1
    assert np.allclose(v, want / np.linalg.norm(want)) and stub.healthy() and not stub.embed("").any()
    assert np.array_equal(providers.decoded_vector(providers.encoded_vector(v)), v)
    with pytest.raises(ValueError):
        providers.decoded_vector(b"123")
    http = providers.HttpEmbedding("http://localhost/v1/", "", "m", 2)
    assert [list(x) for x in http.parsed({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}, 2)] == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        http.parsed({"data": [{"embedding": [1]}]}, 1)
    assert providers.MockLlm({"a": "1"}).complete_json("xax") == 1 and providers.MockLlm({}).complete("y") == '{"observations":[]}'


def test_settings_come_from_the_environment():
    s = config.load({"CORROLITH_ROOT": "/r", "CORROLITH_MAX_TOKENS": "7", "CORROLITH_LLM_MODEL": "m", "CORROLITH_EMBEDDING_DIM": "3"})
    assert (s.root, s.recall.max_tokens, s.llm.model, s.embedding.dim, config.load({}).embedding.dim) == ("/r", 7, "m", 3, 1024)


def test_evidence_stream_equals_the_batch(spark, tmp_path):
    events = spark.createDataFrame([("w", "a", f"b{i % 3}", "shared_entity", ["user_negation", "file_evidence", "assistant_speculation"][i % 4 % 3]) for i in range(20)], "workspace_id string, src string, dst string, relation_type string, evidence string")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.run(streaming.evidence_totals(stream), str(tmp_path / "ck"), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    last = spark.read.parquet(out).groupBy("dst").agg(F.max_by(F.struct("alpha", "beta", "evidence_count"), "batch").alias("e")).select("dst", "e.*")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in graph.fold_edges(events).select("dst", "alpha", "beta", "evidence_count").collect()}
