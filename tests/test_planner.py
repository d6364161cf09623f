"""Sessions, extraction and planning against plain sequential models."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.operators import planner
from corrolith.sources import providers, sessions

NOW = "2026-01-01T00:00:00Z"
FILE = "source_ref string, workspace_id string, content string"


def test_journal(spark):
    text = "# Journal\nlost\n### Lost too\nx\n## Session 12: Title\r\n**Date**: 2026-05-16\nintro\n### Main  Changes\n\n  \n### Summary\n body \n\nmore\n---\nafter rule\n## session 13\nstill\n## Session no number\n### Late\nundated\n**Date**: 2026-05-17\n"
    rows = sessions.journal_sections(spark.createDataFrame([("f", "w", text)], FILE), NOW).collect()
    got = [(r.session_id, r.role, r.content, r.created_at) for r in sorted(rows, key=lambda r: (r.session_id, r.content))]
    assert got == [
        ("Session no number", "header", "Session no number", NOW), ("Session no number", "late", "undated\n**Date**: 2026-05-17", "2026-05-17"),
        ("session_12", "header", "Session 12: Title\n**Date**: 2026-05-16\nintro", "2026-05-16"), ("session_12", "summary", "after rule\n## session 13\nstill", "2026-05-16"), ("session_12", "summary", "body \n\nmore", "2026-05-16"),
    ]


def test_formats(spark):
    files = [("j", "w", "# Journal\n## Session 1\nx"), ("s", "w", '  {"session_id": "a", "messages": [{"role": "user", "content": "hi"}]}'), ("t", "w", "text"), ("e", "w", ""), ("n", "w", None)]
    rows, unknown = sessions.parse_sessions(spark.createDataFrame(files, FILE), NOW)
    assert {(r.session_id, r.content) for r in rows.collect()} == {("session_1", "Session 1\nx"), ("a", "hi")}
    assert {r.source_ref for r in unknown.collect()} == {"t", "e", "n"}
    assert sessions.parse_sessions(spark.createDataFrame([], FILE), NOW)[0].count() == 0
    again = sessions.parse_sessions(spark.createDataFrame(files, FILE), NOW)[0]
    assert {r.memory_id for r in again.collect()} == {r.memory_id for r in rows.collect()}
    with pytest.raises(Exception, match="no JSON session"):
        sessions.json_sessions(spark.createDataFrame([("x", "w", '{"session_id": ')], FILE), NOW).collect()


def _model(candidates, stored):
    """The plan carried out one candidate after another over a list of rows."""
    rows, out = [dict(r) for r in stored], []
    for c in candidates:
        alive = [r for r in rows if r["status"] not in vocab.DEAD and (r["w"], r["s"]) == (c["w"], c["s"])]
        newest = sorted(alive, key=lambda r: (r["at"], r["id"]), reverse=True)
        target = None
        if not c["s"].strip() or (not c["e"] and c["t"] == "assistant_guess"):
            action = "skip"
        elif hit := [r for r in alive if (r["p"], r["o"]) == (c["p"], c["o"])]:
            action, target = "reinforce", min(hit, key=lambda r: (r["at"], r["id"]))
        elif hit := [r for r in newest if r["p"] == c["p"]]:
            action, target = "update", hit[0]
            target["status"] = "superseded"
        elif hit := [r for r in newest if r["o"] == c["o"]]:
            action, target = "merge", hit[0]
        else:
            action = "add"
        out.append((c["id"], action, target["id"] if target else None))
    return set(out)


def test_effects_equal_a_sequential_model(spark):
    r = random.Random(11)
    for turn in range(3):
        stored = [{"id": f"k{i:03}", "w": r.choice("vw"), "s": r.choice("ab"), "p": r.choice(["p", "q", "r"]), "o": r.choice(["1", "2", "3", None]), "status": r.choice(["confirmed", "disputed", "rejected"]), "at": r.randint(0, 20)} for i in range(40)]
        new = [{"id": f"n{i:03}", "w": r.choice("vw"), "s": r.choice(["a", "b", "c", " "]), "p": r.choice(["p", "q", "r", "t"]), "o": r.choice(["1", "2", "4", None]), "e": r.choice(["", "x"]), "t": r.choice(["assistant_guess", "user_message"])} for i in range(30)]
        old = spark.createDataFrame([tuple(x.values()) for x in stored], "observation_id string, workspace_id string, subject_text string, predicate string, object_text string, status string, created_ts int")
        ask = spark.createDataFrame([tuple(x.values()) for x in new], "observation_id string, workspace_id string, subject_text string, predicate string, object_text string, evidence_text string, source_type string").withColumn("place", F.col("observation_id"))
        effects = planner.apply_plan(ask, old)
        assert {(e.candidate_id, e.action, e.target_id) for e in effects.collect()} == _model(new, stored)
        if not turn:
            after = planner.applied(old.withColumns({"evidence_alpha": F.lit(1.0), "superseded_by": F.lit(None).cast("string")}), effects)
            done = {x.observation_id: x for x in after.collect()}
            for k in stored:
                more = [e for e in _model(new, stored) if e[2] == k["id"]]
                assert done[k["id"]].evidence_alpha == 1 + sum(e[1] in ("reinforce", "merge") for e in more)
                assert (done[k["id"]].status == "superseded") == any(e[1] == "update" for e in more)


def test_plan_compares_keys(spark):
    old = spark.createDataFrame([("w", "foo_bar", "has", "Big Thing", "confirmed"), ("w", "foo_bar", "is", None, "rejected")], "workspace_id string, subject_text string, predicate string, object_text string, status string")
    rows = [("1", "Foo Bar", "has", "big-thing"), ("2", "foo_bar", "has", "other"), ("3", "foo bar", "owns", "big_thing"), ("4", "foo_bar", "is", None)]
    new = spark.createDataFrame([(i, "w", s, p, o, "x", "user_message") for i, s, p, o in rows], "id string, workspace_id string, subject_text string, predicate string, object_text string, evidence_text string, source_type string")
    assert {r.id: r.action for r in planner.plan(new, old).collect()} == {"1": "reinforce", "2": "update", "3": "merge", "4": "add"}


def test_extraction_and_reextraction(spark):
    raw = spark.createDataFrame([("m1", "w", "s1", "user", "Disk has room", 0), ("m2", "w", "s1", "assistant", "I see", 1), ("m3", "w", "s2", "user", "nothing", 0)], "memory_id string, workspace_id string, session_id string, role string, content string, seq int").withColumn("extraction_version", F.lit(None).cast("string"))
    said = {"observations": [{"subject_text": "Disk Log", "predicate": "Depends on", "object_text": None, "evidence_text": "has room", "source_type": "file_evidence"}, {"subject_text": "x", "predicate": "has", "evidence_text": "room I see", "source_type": "odd"}, {"subject_text": "y", "predicate": "has", "evidence_text": "I see", "source_type": "odd"}]}
    llm = providers.MockLlm({"[user]: Disk has room\n[assistant]: I see": json.dumps(said)})
    rows = planner.extract(raw, llm, ["seq"], NOW).collect()
    got = {(r.subject_text, r.predicate, r.object_text, r.source_type, r.evidence_alpha, r.extraction_confidence, r.memory_id) for r in rows}
    assert got == {("disk_log", "depends_on", None, "file_evidence", 2.5, 0.9, "m1"), ("y", "has", None, "assistant_guess", 1.0, 0.3, "m1")}
    obs = spark.createDataFrame([("o1", "w", "m1", "confirmed"), ("o2", "w", "m3", "confirmed"), ("o3", "w", "m2", "superseded")], "observation_id string, workspace_id string, memory_id string, status string").withColumn("superseded_by", F.lit(None).cast("string"))
    ledger, stamped = planner.reextract(obs, raw, spark.createDataFrame([("w", "s1"), ("w", "none")], "workspace_id string, session_id string"), llm, ["seq"], NOW, "v9")
    state = {r.observation_id: (r.status, r.superseded_by is not None) for r in ledger.collect()}
    assert len(state) == 5 and (state["o1"], state["o2"], state["o3"]) == (("superseded", True), ("confirmed", False), ("superseded", False))
    assert {r.memory_id: r.extraction_version for r in stamped.collect()} == {"m1": "v9", "m2": "v9", "m3": None}
    with pytest.raises(Exception, match="no JSON reply"):
        planner.extract(raw, providers.MockLlm({}, "sorry"), ["seq"], NOW).collect()


def test_envelope():
    assert planner.envelope_block([], ["e"]).endswith("(none)\n") and planner.envelope_block(["m"], ["e"]).split("\n")[2] == "- m"


def test_a_subject_with_many_rows_is_passed_through_once():
    """The rows of a subject aren't gone through for each candidate: 3000 by 3000 of them took many seconds."""
    rows = [{"subject_text": "s", "predicate": f"p{i % 60}", "object_text": f"q{i % 20}", "status": "confirmed", "created_ts": i, "observation_id": f"k{i}"} for i in range(3000)][::-1]
    ask = [{"subject_text": "s", "predicate": f"p{i * 7 % 60}", "object_text": f"q{i * 3 % 20}", "evidence_text": "x", "source_type": "user_message", "observation_id": f"c{i}"} for i in range(3000)]
    began = time.process_time()
    told = planner.fold_subject(ask, rows)
    assert time.process_time() - began < 2 and len(told) == 3000 and {t["action"] for t in told} >= {"reinforce", "update"}
