"""Retrieval on small scenarios, and its parts against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from corrolith.functions import scalars as S
from corrolith.operators import graph, recall

CONCEPT = "concept_id string, workspace_id string, name string, concept_type string, definition string, related_entities array<string>, known_facts array<string>, rejected_hypotheses array<string>, open_questions array<string>, confidence double, status string, lifecycle_scope string, scope_key string, successful_recall_count long, last_recalled_at string, created_at string"


def concept(spark, *rows):
    """Rows of (id, workspace, name, entities), and more by name."""
    base = {"concept_type": None, "definition": None, "known_facts": None, "rejected_hypotheses": None, "open_questions": None, "confidence": 0.9, "status": "active", "lifecycle_scope": "project", "scope_key": None, "successful_recall_count": 0, "last_recalled_at": None, "created_at": "t0"}
    names = [c.split()[0] for c in CONCEPT.split(", ")]
    full = [base | {"concept_id": i, "workspace_id": w, "name": n, "related_entities": e} | more for i, w, n, e, more in rows]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in full], CONCEPT)
    return df.withColumns({"entities_json": F.to_json("related_entities"), "facts_json": F.to_json("known_facts")})


def vectors(spark, *rows):
    return spark.createDataFrame(rows, "source_type string, source_id string, workspace_id string, vector array<double>")


def test_a_neighbour_by_edge_is_found(spark):
    con = concept(spark, ("a", "w", "disk space", ["disk"], {}), ("b", "w", "crash", ["crash"], {}), ("c", "w", "weather", ["rain"], {}), ("d", "w", "gone", ["x"], {"status": "deprecated"}))
    emb = vectors(spark, ("concept", "a", "w", [1.0, 0.0]), ("concept", "c", "w", [-1.0, 0.0]))
    edges = spark.createDataFrame([("w", "a", "b", "shared_entity", 0.5), ("w", "a", "d", "shared_entity", 0.9), ("v", "a", "c", "shared_entity", 0.9)], "workspace_id string, src string, dst string, relation_type string, weight double")
    hits = {r.concept_id: r for r in recall.compact_search(con, emb, edges, "w", "disk", vectors(spark, ("q", "q", "q", [1.0, 0.0]))).collect()}
    assert set(hits) == {"a", "b"}
    assert hits["b"].score == pytest.approx(0.5 * 0.675) and hits["b"].via == ["forward:shared_entity"]
    assert hits["a"].score == pytest.approx(2 / 61) and (hits["a"].lexical_rank, hits["a"].dense_rank) == (0, 0)
    assert [r.concept_id for r in recall.compact_search(con, emb, edges, "w", "disk", vectors(spark, ("q", "q", "q", [1.0, 0.0])), steps=1).collect()] == ["a"]
    assert recall.compact_search(con, emb.limit(0), edges, "w", "  ", vectors(spark, ("q", "q", "q", [1.0, 0.0]))).count() == 0


def test_a_shared_entity_is_found(spark):
    con = concept(spark, ("a", "w", "disk", ["Disk", "log"], {}), ("b", "w", "other", ["disk"], {}), ("e", "w", "verbatim", ["Disk"], {}), ("f", "v", "far", ["DISK"], {"lifecycle_scope": "global"}), ("g", "v", "hidden", ["disk"], {}))
    edges = spark.createDataFrame([], "workspace_id string, src string, dst string, relation_type string, weight double")
    q = vectors(spark, ("q", "q", "q", [1.0]))
    hits = {r.concept_id: r for r in recall.compact_search(con, q.limit(0), edges, "w", "log", q, see=recall.Visibility((), True)).collect()}
    assert set(hits) == {"a", "b", "f"}  # a stored entity is matched as it is in the workspace, by its key elsewhere
    assert hits["b"].score == pytest.approx(0.50625) and hits["f"].score == pytest.approx(0.50625 * 0.8)


def test_query_entities_by_vocabulary(spark):
    keys = lambda text, words=None: spark.createDataFrame([(text,)], "t string").select(recall.query_entities(F.col("t"), words)).first()[0]
    assert keys("Why does the Disk-Log, disk log fail?") == ["does", "disk_log", "disk", "log", "fail"]
    assert keys("确认POSMASK有没有机器字段", ["posmask", "机器字段", "机器"]) == ["posmask", "机器字段"]
    assert keys("ＤＩＳＫ", ["x"]) == ["disk"] and keys("未知的词", ["x"]) == ["未知的词"] and keys("") == [] and keys(None) is None


def test_segments_match_the_longest_key_first(spark):
    words = ["ab", "abc", "cd", "bcd", "x"]
    r = random.Random(3)
    texts = ["".join(r.choice("abcdx") for _ in range(12)) for _ in range(50)]

    def plain(t):
        out, i = [], 0
        while i < len(t):
            best = max((w for w in words if len(w) >= 2 and t.startswith(w, i)), key=len, default=None)
            out += [best] if best else []
            i += len(best) if best else 1
        return out

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(S.alternation(words)), F.lit(0)).alias("k")).collect()
    assert all(row.k == plain(row.t) for row in got)


def test_recency_of_odd_anchors(spark):
    rows = [("2026-01-01T00:00:00Z", 0.0), ("2025-12-31T22:00:00+01:00", 3 / 24), ("2030-01-01T00:00:00Z", 0.0), ("t0", None), ("2025-12-01", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(recall.days_between("2026-01-01T00:00:00Z", F.col("a")).alias("d"))
    assert [r.d for r in df.collect()] == [d for _, d in rows]


def test_dual_rank_gates(spark):
    con = concept(spark, ("a", "w", "a", ["disk"], {}), ("b", "w", "b", ["disk", "log"], {"status": "disputed"}), ("c", "w", "c", ["x"], {"status": "labile"}), ("d", "v", "d", ["disk"], {}))
    emb = vectors(spark, ("concept", "b", "w", [1.0, 0.0]), ("concept", "c", "w", [1.0, 0.0]), ("concept", "orphan", "w", [1.0, 1.0]), ("observation", "o", "w", [1.0, 0.0]))
    got = {r.concept_id: r for r in recall.rank(con, emb, "w", ["disk"], vectors(spark, ("q", "q", "q", [1.0, 0.0])), "2026-01-01T00:00:00Z").collect()}
    assert set(got) == {"a", "b", "orphan"}
    assert got["a"].score == pytest.approx(0.4) and got["b"].score == pytest.approx(0.6) and got["orphan"].score == pytest.approx(0.6 * 2**-0.5)


def test_context_is_cut_and_shortened(spark):
    con = concept(spark, ("a", "w", "A", ["e1", "e2", "e1"], {"definition": "def", "known_facts": ["f" * 80, "g"], "concept_type": "preference", "open_questions": ["why?"]}), ("b", "w", "B", ["e2", "e3"], {"status": "disputed", "known_facts": ["g"], "rejected_hypotheses": ["no", ""]}))
    best = con.withColumn("place", F.when(F.col("concept_id") == "a", 0).otherwise(1))
    r = recall.build_context(best, "w", "general_query", 1500).first()
    assert (r.current_concept, r.known_facts, r.rejected_hypotheses, r.task_state, r.relevant_entities, r.user_preferences) == ("A", ["A: def", "f" * 80, "g"], ["B is disputed", "no"], ["why?"], ["e1", "e2", "e3"], ["f" * 80, "g"])
    assert r.token_count == -(-len(r.prompt) // 4) and r.prompt.endswith("preferences.")
    small = recall.build_context(best, "w", "general_query", 80).first()
    assert small.relevant_entities == ["e1", "e2", "e3"][: len(small.relevant_entities)] and len(small.known_facts) < 3


def test_shortening_gives_up_the_least_needed_first():
    r = random.Random(5)
    for _ in range(200):
        make = lambda: ["x" * r.randint(1, 30) for _ in range(r.randint(0, 4))]
        c = recall.MemoryContext("w", "general_query", "c", make(), make(), make(), make(), make())
        items = {s: list(getattr(c, s)) for s in recall.SECTIONS}
        most = r.randint(40, 150)
        c.shorten(most)
        assert c.tokens() <= most or not any(getattr(c, s) for s in recall.SECTIONS)
        cut = [s for s in recall.GIVEN_UP if getattr(c, s) != items[s]]
        assert all(getattr(c, s) == items[s][: len(getattr(c, s))] for s in recall.SECTIONS)
        assert all(not getattr(c, s) for s in recall.GIVEN_UP[: recall.GIVEN_UP.index(cut[-1])]) if cut else True


def test_prefix_within_budget(spark):
    r = random.Random(7)
    rows = [(["x" * r.randint(1, 40) for _ in range(r.randint(0, 6))], b) for b in (0, 5, 20) for _ in range(20)]
    for b in (0, 5, 20):
        mine = [x for x, y in rows if y == b]
        got = spark.createDataFrame([(i, x) for i, x in enumerate(mine)], "i int, x array<string>").select("i", recall.within(F.col("x"), b).alias("y")).collect()
        for row in got:
            used, want = 0, []
            for item in mine[row.i]:
                used += max(1, -(-len(item) // 4))
                if used > b:
                    break
                want.append(item)
            assert row.y == want


def test_promotion_never_lowers_and_needs_a_key(spark):
    df = spark.createDataFrame([("g", "global", None, 3, 0), ("p", "project", None, 2, 0), ("d", "domain", "k", 3, 0), ("x", "project", None, 3, 1)], "concept_id string, lifecycle_scope string, scope_key string, cross_project_count int, conflict_count int")
    df = df.withColumns({"confidence": F.lit(0.9), "connection_count": F.lit(3), "recall_count": F.lit(0)})
    done = lambda key: {r.concept_id: (r.lifecycle_scope, r.scope_key, r.changed, r.reported) for r in graph.promoted(graph.promotion(df), key).collect()}
    assert done("new") == {"g": ("global", None, False, "global"), "p": ("domain", "new", True, "domain"), "d": ("global", None, True, "global"), "x": ("project", None, False, None)}
    assert done(None)["p"] == ("project", None, False, None)
