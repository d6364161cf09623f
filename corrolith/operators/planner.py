"""From messages to observations: extraction, the evidence gate, what to do with each candidate, and re-extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators.ledger import live
from corrolith.sources.providers import LlmProvider, completed

REPLY = "observations array<struct<subject_text: string, subject_type: string, predicate: string, object_text: string, object_type: string, evidence_text: string, source_type: string>>"


def prompts(raw: DataFrame, order: list[str]) -> DataFrame:
    """One prompt per session from its messages in order: workspace_id, session_id, memory_id (of the first message), prompt."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "memory_id", F.concat(F.lit("["), "role", F.lit("]: "), "content").alias("__line")))), lambda x: x["__line"])
    return raw.groupBy("workspace_id", "session_id").agg(F.min_by("memory_id", F.struct(*order)).alias("memory_id"), F.concat(F.lit("Input messages:\n"), F.array_join(lines, "\n"), F.lit("\n\nOutput:")).alias("prompt"))


def supported(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """Candidates whose evidence is not empty and stands word for word in one message of their session. The join is on the
    session, and a session that asks twice for the same evidence is asked once."""
    asked = candidates.filter("evidence_text <> ''").select("workspace_id", "session_id", "evidence_text").distinct()
    found = raw.select("workspace_id", "session_id", "content").join(asked, ["workspace_id", "session_id"]).filter(F.contains("content", F.col("evidence_text"))).select("workspace_id", "session_id", "evidence_text").distinct()
    return candidates.join(found, ["workspace_id", "session_id", "evidence_text"], "left_semi")


def extract(raw: DataFrame, llm: LlmProvider, order: list[str], now: str, system: str | None = None) -> DataFrame:
    """Observations of each session's reply that its messages support. A reply that is no such JSON is an error."""
    asked = prompts(raw, order)
    replies = completed(asked, "prompt", llm, system)
    parsed = replies.withColumn("r", F.from_json(S.without_fences(F.col("reply")), REPLY))
    bad = F.col("r").isNull() | F.col("r.observations").isNull()
    parsed = parsed.withColumn("o", F.when(bad, F.raise_error(F.concat(F.lit("no JSON reply for "), "session_id")).cast(parsed.schema["r"].dataType["observations"].dataType)).otherwise(F.col("r.observations")))
    rows = parsed.select("workspace_id", "session_id", "memory_id", F.posexplode("o").alias("place", "o")).select("workspace_id", "session_id", "memory_id", "place", "o.*")
    kept = supported(rows, raw)
    source = S.known_source(F.col("source_type"))
    alpha, beta = S.evidence_seed(source)
    batch = F.md5(F.concat_ws("\x00", "workspace_id", "session_id", F.lit(now)))
    return kept.select(
        F.md5(F.concat_ws("\x00", batch, F.col("place").cast("string"))).alias("observation_id"), "workspace_id", "session_id", "memory_id", "place", S.key_light(F.col("subject_text")).alias("subject_text"),
        "subject_type", S.predicate_key(F.col("predicate")).alias("predicate"), S.key_light(F.col("object_text")).alias("object_text"), "object_type", "evidence_text",
        S.looked_up(source, vocab.TRUST, 0.3).alias("extraction_confidence"), alpha.alias("evidence_alpha"), beta.alias("evidence_beta"), F.lit("candidate").alias("status"),
        source.alias("source_type"), batch.alias("extraction_batch_id"), F.lit(None).cast("string").alias("superseded_by"), F.lit(1).cast("long").alias("cross_project_count"), F.lit(now).alias("created_at"),
    )


def skipped(subject: Column, evidence: Column, source: Column) -> Column:
    """Candidates that are dropped: no subject, or a guess without evidence."""
    blank = lambda c: S.trimmed(F.coalesce(c, F.lit(""))) == ""
    return blank(subject) | (blank(evidence) & (source == "assistant_guess"))


def plan(candidates: DataFrame, existing: DataFrame, normal=S.nfkc) -> DataFrame:
    """candidates with action: skip, reinforce (the triple is live), update (its object changed), merge (another predicate of
    the same subject and object) or add.

    What is live is first reduced to its distinct keys, so a frequent subject costs one row for each of its triples.
    """
    keys = lambda df: df.withColumns({"__s": S.key_light(F.col("subject_text"), normal), "__o": S.key_light(F.col("object_text"), normal)})
    told = keys(live(existing).select("workspace_id", "subject_text", "predicate", "object_text").distinct())
    # rows are found by their stored text: the subject as it is, or the object
    told = told.withColumn("__by_subject", F.col("subject_text") == F.col("__s")).filter("__by_subject OR (object_text <> '' AND object_text = __o)")
    triples = told.select(F.col("workspace_id").alias("w"), F.col("__s").alias("s"), F.col("predicate").alias("p"), F.col("__o").alias("o")).distinct()
    subjects = told.filter("__by_subject").select(F.col("workspace_id").alias("w"), F.col("__s").alias("s"), F.col("predicate").alias("p")).distinct()
    pairs = triples.select("w", "s", "o").distinct()
    rows = keys(candidates)
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    at = lambda d: (rows["workspace_id"] == d["w"]) & (rows["__s"] == d["s"])
    for d, name, more in ((triples, "__t", lambda d: (rows["predicate"] == d["p"]) & rows["__o"].eqNullSafe(d["o"])), (subjects, "__sp", lambda d: rows["predicate"] == d["p"]), (pairs, "__so", lambda d: rows["__o"].eqNullSafe(d["o"]))):
        d = flag(d, name)
        rows = rows.join(d, at(d) & more(d), "left").drop("w", "s", "p", "o")
    drop = skipped(F.col("subject_text"), F.col("evidence_text"), F.col("source_type"))
    action = F.when(drop, "skip").when(F.col("__t"), "reinforce").when(F.col("__sp"), "update").when(F.col("__so"), "merge").otherwise("add")
    return rows.withColumn("action", action).drop("__s", "__o", "__t", "__sp", "__so")


def _effects(candidates, existing) -> list[tuple]:
    """What fold_subject tells, as (candidate, action, target): candidates are (subject, predicate, object, evidence, source,
    id), existing (subject, predicate, object, status, created_ts, id). Rows are only ever superseded, so each list of rows is
    passed through once, whatever the number of candidates."""
    rows = [r for r in existing if r[3] not in vocab.DEAD]
    gone = [False] * len(rows)
    triple, by_predicate, by_object = {}, {}, {}
    for i, (s, p, o, *_) in enumerate(rows):
        triple.setdefault((s, p, o), []).append(i)
        by_predicate.setdefault((s, p), []).append(i)
        by_object.setdefault((s, o), []).append(i)
    for listed in triple.values():
        listed.sort(key=lambda i: (rows[i][4], rows[i][5]), reverse=True)
    for lists in (by_predicate, by_object):  # the next one is last
        for listed in lists.values():
            listed.reverse()

    def first(lists: dict, key: tuple) -> int | None:
        listed = lists.get(key)
        while listed and gone[listed[-1]]:
            listed.pop()
        return listed[-1] if listed else None

    out = []
    for s, p, o, evidence, source, id_ in candidates:
        at = None
        if not (s or "").strip() or (not (evidence or "").strip() and source == "assistant_guess"):
            action = "skip"
        elif (at := first(triple, (s, p, o))) is not None:
            action = "reinforce"
        elif (at := first(by_predicate, (s, p))) is not None:
            action = "update"
            gone[at] = True
        elif (at := first(by_object, (s, o))) is not None:
            action = "merge"
        else:
            action = "add"
        out.append((id_, action, None if at is None else rows[at][5]))
    return out


_OURS, _THEIRS = ("subject_text", "predicate", "object_text", "evidence_text", "source_type", "observation_id"), ("subject_text", "predicate", "object_text", "status", "created_ts", "observation_id")


def fold_subject(candidates: list[dict], existing: list[dict]) -> list[dict]:
    """What the candidates of one subject do, in order, to the live rows of that subject (newest first). One record per effect:
    candidate_id, action, and the row that it reinforces, merges into or supersedes. What a candidate adds is not seen by
    later ones."""
    told = _effects([tuple(c[n] for n in _OURS) for c in candidates], [tuple(r[n] for n in _THEIRS) for r in existing])
    return [dict(zip(("candidate_id", "action", "target_id"), t)) for t in told]


EFFECTS = "workspace_id string, subject_text string, candidate_id string, action string, target_id string"


def apply_plan(candidates: DataFrame, existing: DataFrame, order: str = "place") -> DataFrame:
    """The effects of all candidates, one subject at a time and within it in order. candidates and existing hold entity keys
    as subjects and objects. Of the live rows of a subject only those go along that a candidate can reach: as many of the
    newest of each predicate and of each object as there are candidates, and the oldest of each triple."""
    key = ["workspace_id", "subject_text"]
    n = candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    rows = live(existing).select(*key, "predicate", "object_text", "status", "observation_id", "created_ts").join(n, key)
    newest = [F.desc("created_ts"), F.desc("observation_id")]
    place = lambda *c: F.row_number().over(Window.partitionBy(*key, *c).orderBy(*newest))
    oldest = F.row_number().over(Window.partitionBy(*key, "predicate", "object_text").orderBy("created_ts", "observation_id"))
    near = rows.withColumns({"__p": place("predicate"), "__o": place("object_text"), "__t": oldest}).filter("__p <= __n OR __o <= __n OR __t <= __n").drop("__p", "__o", "__t", "__n")
    asked = candidates.select(*key, "predicate", "object_text", "evidence_text", "source_type", "observation_id", F.col(order).alias("place"))

    def fold(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        columns = ["workspace_id", "subject_text", "candidate_id", "action", "target_id"]
        if not len(ours):
            return pd.DataFrame(columns=columns)
        clean = lambda f, names: zip(*(f[n].astype(object).where(f[n].notna(), None).tolist() for n in names))
        ours = ours.sort_values(["place", "observation_id"])
        theirs = theirs.sort_values(["created_ts", "observation_id"], ascending=False)
        out = pd.DataFrame(_effects(clean(ours, _OURS), clean(theirs, _THEIRS)), columns=columns[2:])
        out.insert(0, "workspace_id", ours["workspace_id"].iloc[0])
        out.insert(1, "subject_text", ours["subject_text"].iloc[0])
        return out

    return asked.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(fold, EFFECTS)


def applied(existing: DataFrame, effects: DataFrame) -> DataFrame:
    """existing after the effects: reinforced and merged rows gain one alpha each time, updated ones are superseded."""
    hit = effects.filter("target_id IS NOT NULL").groupBy(F.col("target_id").alias("observation_id")).agg(
        F.sum(F.col("action").isin("reinforce", "merge").cast("double")).alias("__more"), F.max(F.when(F.col("action") == "update", F.concat(F.lit("update:"), "candidate_id"))).alias("__by")
    )
    out = existing.join(hit, "observation_id", "left")
    return out.withColumns(
        {"evidence_alpha": F.col("evidence_alpha") + F.coalesce("__more", F.lit(0.0)), "status": F.when(F.col("__by").isNotNull(), "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("__by", "superseded_by")}
    ).drop("__more", "__by")


def superseded_sessions(obs: DataFrame, raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """obs after the re-extraction of sessions (workspace_id, session_id, batch_id): rows that came from their messages and
    are not superseded yet are, by the new batch."""
    memories = raw.join(sessions.select("workspace_id", "session_id", F.col("batch_id").alias("__batch")), ["workspace_id", "session_id"]).select("memory_id", "__batch").dropDuplicates(["memory_id"])
    out = obs.join(memories.withColumn("__hit", F.lit(True)), "memory_id", "left")
    now = F.col("__hit") & (F.col("status") != "superseded")
    by = F.col("superseded_by") if "superseded_by" in obs.columns else F.lit(None).cast("string")
    return out.withColumns({"superseded_by": F.when(now, F.col("__batch")).otherwise(by), "status": F.when(now, "superseded").otherwise(F.col("status"))}).drop("__hit", "__batch")


def reextract(obs: DataFrame, raw: DataFrame, sessions: DataFrame, llm: LlmProvider, order: list[str], now: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Extracts sessions anew: the ledger with their old rows superseded and the new ones added, and their messages stamped
    with the version. Sessions without messages change nothing."""
    own = raw.join(sessions.select("workspace_id", "session_id"), ["workspace_id", "session_id"], "left_semi")
    new = extract(own, llm, order, now)
    batch = F.md5(F.concat_ws("\x00", "workspace_id", "session_id", F.lit(now)))
    old = superseded_sessions(obs, own, own.select("workspace_id", "session_id").distinct().withColumn("batch_id", batch))
    stamped = raw.join(sessions.select("workspace_id", "session_id").withColumn("__hit", F.lit(True)), ["workspace_id", "session_id"], "left")
    stamped = stamped.withColumn("extraction_version", F.when(F.col("__hit"), version).otherwise(F.col("extraction_version"))).drop("__hit")
    return old.unionByName(new, allowMissingColumns=True), stamped


def envelope_block(context: list[str], evidence: list[str]) -> str:
    """The part of a prompt that tells memories for context from messages that may be evidence."""
    lines = ["", "## Contextual existing memories (DO NOT restate unless confirmed by evidence)", *(["(none)"] if not context else [f"- {m}" for m in context])]
    return "\n".join(lines + (["", "## Extractable evidence messages", *evidence] if context else [])) + "\n"
