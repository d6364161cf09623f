"""Versions of properties, and feedback folded into concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions.scalars import days_since, evidence_seed, feedback_class, key_light, looked_up, merged_entities, nfkc, persistence_class


def versions(events: DataFrame) -> DataFrame:
    """Each event opens a version that ends when the next one of its entity and property begins."""
    w = Window.partitionBy("workspace_id", "entity", "property").orderBy("valid_from", "seq")
    out = events.withColumns({"valid_to": F.lead("valid_from").over(w), "superseded_by": F.lead("seq").over(w)})
    return out.withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


def versions_with_expiry(events: DataFrame) -> DataFrame:
    """As versions(), where an event of kind `expire` ends what is held without a new value. Only appended values are
    versions: active, superseded by the next one, or expired."""
    w = Window.partitionBy("workspace_id", "entity", "property").orderBy("valid_from", "seq")
    out = events.withColumns({"valid_to": F.lead("valid_from").over(w), "__next": F.lead("kind").over(w), "superseded_by": F.lead("seq").over(w)}).filter("kind = 'append'")
    ended = F.col("__next") == "expire"
    return out.withColumns({"status": F.when(F.col("__next").isNull(), "active").when(ended, "expired").otherwise("superseded"), "superseded_by": F.when(~ended, F.col("superseded_by"))}).drop("__next", "kind")


def history_of(entries: DataFrame, workspace: str, entity: str, prop: str | None = None) -> DataFrame:
    """Versions of an entity, of one property if given. A listing shows them by property, the newest first."""
    own = entries.filter((F.col("workspace_id") == workspace) & (F.col("entity") == entity))
    return own if prop is None else own.filter(F.col("property") == prop)


def from_observations(obs: DataFrame, now: Column, normal=nfkc) -> DataFrame:
    """The timeline events that observations are: the object is the value that the subject has for the predicate from now on."""
    return obs.select("workspace_id", key_light(F.col("subject_text"), normal).alias("entity"), F.col("predicate").alias("property"), F.col("object_text").alias("value"), "observation_id", now.alias("valid_from"), F.col("observation_id").alias("seq"))


def history_lines(entries: DataFrame) -> DataFrame:
    """entries with line: one line of text for each version."""
    mark = F.when(F.col("status") == "active", "●").otherwise("○")
    return entries.withColumn("line", F.concat(mark, F.lit(" "), "property", F.lit("="), F.coalesce("value", F.lit("?")), F.lit(" ("), "valid_from", F.lit(" → "), F.coalesce("valid_to", F.lit("now")), F.lit(")")))


def current(events: DataFrame) -> DataFrame:
    """The newest value of each property, by one aggregation without sorting."""
    newest = events.groupBy("workspace_id", "entity", "property").agg(F.max(F.struct("valid_from", "seq", "value")).alias("v"), F.count("*").alias("n_versions"))
    return newest.select("workspace_id", "entity", "property", F.col("v.seq").alias("seq"), F.col("v.value").alias("value"), "n_versions")


def as_of(events: DataFrame, at) -> DataFrame:
    """What was held at a time."""
    return versions(events).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def classified(feedback: DataFrame) -> DataFrame:
    """Adds the feedback's type and persistence; temporary feedback counts as general and is not durable."""
    scope = persistence_class(F.col("feedback_text"))
    return feedback.withColumn("persistence", scope).withColumn("feedback_type", F.when(F.col("persistence") == "task_temporary", "general").otherwise(feedback_class(F.col("feedback_text"))))


def ledger(feedback: DataFrame) -> DataFrame:
    """The rows that durable feedback leaves in the ledger, with what it adds to alpha and beta; temporary feedback leaves
    none."""
    kind = F.col("feedback_type")
    delta = lambda i: looked_up(kind, {k: v[i] for k, v in vocab.FEEDBACK.items()}, 0.0)
    return classified(feedback).filter("persistence <> 'task_temporary'").withColumns({"alpha_delta": delta(0), "beta_delta": delta(1)})


def folded(feedback: DataFrame, concepts: DataFrame, floor: float = 0.4, grace: float = 30.0) -> DataFrame:
    """Concepts after their durable feedback in order (ts, event_id): evidence, counts of good and bad outcomes, and status,
    which turns to deprecated once confidence is under the floor at any event. A candidate has its days of grace first,
    counted from created_ts where concepts have it."""
    held = [c for c in ("created_ts",) if c in concepts.columns]
    rows = ledger(feedback).select("concept_id", "event_id", "ts", "feedback_type", "alpha_delta", "beta_delta")
    rows = rows.join(concepts.select("concept_id", "evidence_alpha", "evidence_beta", "status", *held), "concept_id")
    upto = Window.partitionBy("concept_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("feedback_type")
    run = rows.withColumns({"a": F.col("evidence_alpha") + F.sum("alpha_delta").over(upto), "b": F.col("evidence_beta") + F.sum("beta_delta").over(upto)})
    young = F.col("status") == "candidate"
    old = (days_since(F.col("ts").cast("timestamp"), F.col("created_ts").cast("timestamp")) > grace) if held else F.lit(False)
    low = (F.col("a") / (F.col("a") + F.col("b")) < floor) & (F.col("status").isin("active", "labile") | (young & old))
    out = run.withColumn("low", low).groupBy("concept_id").agg(
        F.max("a").alias("evidence_alpha"), F.max("b").alias("evidence_beta"), F.first("status").alias("status"), F.max("low").alias("low"),
        F.sum(kind.isin("confirm", "supplement", "preference").cast("long")).alias("successful"), F.sum(kind.isin("negate", "correct").cast("long")).alias("failed"), F.count("*").alias("n_feedback"),
    )
    return out.withColumn("status", F.when(F.col("low"), "deprecated").otherwise(F.col("status"))).drop("low")


def kept_texts(feedback: DataFrame, kinds: list[str]) -> DataFrame:
    """concept_id and the distinct texts of some kinds of feedback, in order of their first time."""
    rows = classified(feedback).filter((F.col("persistence") != "task_temporary") & F.col("feedback_type").isin(*kinds))
    first = rows.groupBy("concept_id", "feedback_text").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "feedback_text"))), lambda x: x["feedback_text"]).alias("texts"))


def revised(feedback: DataFrame, concepts: DataFrame, normal=nfkc) -> DataFrame:
    """Concepts after all durable feedback: what folded() gives, confidence, and what texts add: negations to
    rejected_hypotheses, preferences to known_facts and, where there is none, to concept_type, supplements to
    related_entities. Concepts without feedback stay as they are."""
    new = folded(feedback, concepts).select("concept_id", F.col("evidence_alpha").alias("__a"), F.col("evidence_beta").alias("__b"), F.col("status").alias("__status"), "successful", "failed")
    out = concepts.join(new, "concept_id", "left")
    empty = F.array().cast("array<string>")
    for kind, column in (("negate", "__no"), ("preference", "__like"), ("supplement", "__more")):
        out = out.join(kept_texts(feedback, [kind]).withColumnRenamed("texts", column), "concept_id", "left")
    alpha, beta = F.coalesce("__a", "evidence_alpha"), F.coalesce("__b", "evidence_beta")
    united = lambda held, more: F.array_union(F.coalesce(F.col(held), empty), F.coalesce(F.col(more), empty))
    supplements = F.array_join(F.coalesce(F.col("__more"), empty), " . ")
    return out.withColumns({
        "confidence": F.when(F.col("__a").isNull(), F.col("confidence")).otherwise(alpha / (alpha + beta)), "status": F.coalesce("__status", "status"),
        "concept_type": F.when(F.col("concept_type").isNull() & F.col("__like").isNotNull(), "preference").otherwise(F.col("concept_type")),
        "rejected_hypotheses": united("rejected_hypotheses", "__no"), "known_facts": united("known_facts", "__like"),
        "related_entities": F.when(F.col("__more").isNull(), F.col("related_entities")).otherwise(F.array_distinct(merged_entities(F.col("related_entities"), supplements, normal))),
        "successful_recall_count": F.col("successful_recall_count") + F.coalesce("successful", F.lit(0)),
    }).withColumns({"evidence_alpha": alpha, "evidence_beta": beta}).drop("__a", "__b", "__status", "__no", "__like", "__more", "successful", "failed")


def corrected(feedback: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations after feedback with a target (observation_id): a negation adds to its beta each time; the first
    correction supersedes it, and every correction adds an observation with the text as object."""
    rows = classified(feedback).filter("persistence <> 'task_temporary' AND observation_id IS NOT NULL")
    hit = rows.groupBy("observation_id").agg(F.sum((F.col("feedback_type") == "negate").cast("long")).alias("__no"), F.max(F.when(F.col("feedback_type") == "correct", F.struct("ts", "event_id"))).alias("__fix"))
    ident = lambda event: F.concat(F.lit("fix-"), event.cast("string"))
    out = obs.join(hit, "observation_id", "left")
    old = out.withColumns({
        "evidence_beta": F.col("evidence_beta") + F.lit(vocab.EVIDENCE["user_negation"][1]) * F.coalesce("__no", F.lit(0)),
        "status": F.when(F.col("__fix").isNotNull(), "superseded").otherwise(F.col("status")), "superseded_by": F.when(F.col("__fix").isNotNull(), ident(F.col("__fix.event_id"))).otherwise(F.col("superseded_by")),
    }).drop("__no", "__fix")
    alpha, beta = evidence_seed(F.lit("user_confirm"))
    fixes = rows.filter("feedback_type = 'correct'").select("observation_id", "event_id", "feedback_text").join(obs.select("observation_id", "workspace_id", "subject_text", "predicate"), "observation_id")
    new = fixes.select(ident(F.col("event_id")).alias("observation_id"), "workspace_id", "subject_text", "predicate", F.col("feedback_text").alias("object_text"), alpha.alias("evidence_alpha"), beta.alias("evidence_beta"), F.lit("candidate").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.lit("user_confirm").alias("source_type"), F.lit(vocab.TRUST["user_confirm"]).alias("extraction_confidence"))
    return old.unionByName(new, allowMissingColumns=True)
