"""Retrieval: lexical and dense channels, their fusion, graph expansion, ranking and the context of an answer.

A query is a value, its results are tables. Channels keep a bounded number of best rows, by definition of the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions import scalars as S
from corrolith.operators import graph, vectors

#: Weights of the channels, their lengths, the constant of rank fusion, steps of expansion.
SEMANTIC, ENTITY, DENSE_K, FUSION, SEEDS, NEIGHBOURS, OWNERS = 0.6, 0.4, 10, 60, 5, 5, 20
FIRST_STEP, STEP_DECAY, REVERSE, FOREIGN = 0.45, 0.5, 0.75, 0.8


@dataclass(frozen=True)
class Visibility:
    """What other workspaces show: concepts of the named domains, and global ones."""

    domains: tuple[str, ...] = ()
    with_global: bool = False


# ---- channels ----


def lexical_score(query: Column, name: Column, definition: Column, entities: Column, facts: Column) -> Column:
    """How well the text of a concept fits a query; entities and facts are matched in their serialised form."""
    q = F.lower(query)
    parts = F.filter(F.split(F.trim(q), r"\s+"), lambda t: F.char_length(t) >= 2)
    hits = lambda text: F.coalesce(F.size(F.filter(parts, lambda t: F.contains(text, t))), F.lit(0))
    has = lambda text, points: F.when(F.contains(text, q), points).otherwise(0.0)
    d, e, f = F.lower(definition), F.lower(entities), F.lower(facts)
    score = has(F.lower(name), 3.0) + F.when(d.isNull(), 0.0).otherwise(has(d, 2.0) + 0.5 * hits(d)) + F.when(e.isNull(), 0.0).otherwise(has(e, 2.5) + 0.8 * hits(e)) + F.when(f.isNull(), 0.0).otherwise(has(f, 1.5))
    return F.when(F.trim(q) == "", 0.0).otherwise(score)


def lexical_rank(concepts: DataFrame, query: str, k: int) -> DataFrame:
    """The k best concepts by text: concept_id, score, rank from 0."""
    scored = concepts.select("concept_id", lexical_score(F.lit(query), F.col("name"), F.col("definition"), F.col("entities_json"), F.col("facts_json")).alias("score"))
    return ranked(scored.filter("score > 0"), "concept_id", k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows by score with their rank from 0; ties go to the smaller key. Only k rows are numbered."""
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def dense_topk(embeddings: DataFrame, concepts: DataFrame, query: DataFrame, workspace: str, k: int, see: Visibility = Visibility(), least: float = 0.0) -> DataFrame:
    """The k vectors most like the query's (one row, column vector): source_type, source_id, score. Searched are the vectors of
    the workspace and those of visible concepts elsewhere; of a source_id with several types the first type counts."""
    rows = embeddings.filter(F.col("workspace_id") == workspace)
    if see.with_global or see.domains:
        seen = graph.elevated(concepts, list(see.domains), see.with_global)
        foreign = embeddings.filter((F.col("workspace_id") != workspace) & (F.col("source_type") == "concept"))
        rows = rows.union(foreign.join(seen.select(F.col("concept_id").alias("source_id")), "source_id", "left_semi").select(*rows.columns))
    first = rows.groupBy("source_id").agg(F.min(F.struct("source_type", "vector")).alias("e")).select("source_id", "e.source_type", "e.vector")
    one = F.broadcast(query.select(F.col("vector").alias("__q")).limit(1))  # a single row
    scored = first.join(one).select("source_type", "source_id", S.cosine(F.col("vector"), F.col("__q")).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "source_id").limit(k)


def concept_hits(dense: DataFrame) -> DataFrame:
    """Of dense hits the concepts, ranked anew from 0."""
    rows = dense.filter("source_type = 'concept'").select(F.col("source_id").alias("concept_id"), "score")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "concept_id")) - 1)


def hybrid_seed(lexical: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Both ranked lists fused: concept_id, score, lexical_rank, dense_rank; the k best."""
    both = lexical.select("concept_id", F.col("rank").alias("lexical_rank"), F.lit(None).cast("int").alias("dense_rank")).union(dense.select("concept_id", F.lit(None).cast("int"), F.col("rank")))
    merged = both.groupBy("concept_id").agg(F.max("lexical_rank").alias("lexical_rank"), F.max("dense_rank").alias("dense_rank"))
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c) + 1), F.lit(0.0))
    return merged.withColumn("score", part("lexical_rank") + part("dense_rank")).orderBy(F.desc("score"), "concept_id").limit(k)


# ---- expansion ----


def step_weight(steps: int) -> float:
    """Sum of the weights of all expansion steps: each expands the same seeds at half the weight of the one before."""
    return sum(FIRST_STEP * STEP_DECAY**i for i in range(max(0, steps - 1)))


def forward_expand(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, workspace: str, weight: float, see: Visibility = Visibility()) -> DataFrame:
    """What the strongest edges of the seeds (concept_id) lead to: concept_id, score, via. Each seed gives its NEIGHBOURS
    strongest edges, whatever they lead to; seeds, concepts that can't be seen and those not recallable are left out then."""
    own = edges.filter(F.col("workspace_id") == workspace).select("src", "dst", "relation_type", "weight")
    both = own.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type", "weight"))
    near = both.join(F.broadcast(seeds.select(F.col("concept_id").alias("src"))), "src")  # at most SEEDS rows
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "relation_type"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS).withColumnRenamed("dst", "concept_id").join(seeds.select("concept_id"), "concept_id", "left_anti")
    can = graph.visible(concepts, workspace, list(see.domains), see.with_global).filter(F.col("status").isin(*vocab.RECALLABLE)).select("concept_id")
    hits = near.join(can, "concept_id")
    return hits.groupBy("concept_id").agg((F.sum("weight") * weight).alias("score"), F.array_sort(F.collect_set(F.concat(F.lit("forward:"), "relation_type"))).alias("via"))


def reverse_expand(seeds: DataFrame, concepts: DataFrame, workspace: str, weight: float, see: Visibility = Visibility(), normal=S.nfkc) -> DataFrame:
    """Other concepts that have an entity of the seeds: concept_id, score, via. Entities of seeds are keys; in the workspace
    they must equal a stored entity as it is, and each gives its OWNERS most confident active owners; visible active
    concepts elsewhere are matched by key and weigh less."""
    key = lambda c: S.key_light(F.col(c), normal)
    of_seeds = concepts.join(F.broadcast(seeds.select("concept_id")), "concept_id").select(F.explode("related_entities").alias("raw")).select(key("raw").alias("entity")).distinct()
    active = concepts.filter("status = 'active'")
    own = active.filter(F.col("workspace_id") == workspace).select("concept_id", "confidence", F.explode(F.array_distinct("related_entities")).alias("entity")).join(F.broadcast(of_seeds), "entity")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("confidence"), "concept_id"))
    own = own.withColumn("rank", rank).filter(F.col("rank") <= OWNERS).select("concept_id", "entity", F.lit(weight).alias("points"), F.lit("reverse_entity:").alias("kind"))
    if see.with_global or see.domains:
        seen = graph.visible(active.filter(F.col("workspace_id") != workspace), workspace, list(see.domains), see.with_global)
        keys = seen.select("concept_id", F.explode("related_entities").alias("raw")).select("concept_id", key("raw").alias("entity")).distinct()
        own = own.union(keys.join(F.broadcast(of_seeds), "entity").select("concept_id", "entity", F.lit(weight * FOREIGN).alias("points"), F.lit("reverse_elevated:").alias("kind")))
    hits = own.join(seeds.select("concept_id"), "concept_id", "left_anti")
    return hits.groupBy("concept_id").agg(F.sum("points").alias("score"), F.array_sort(F.collect_set(F.concat("kind", "entity"))).alias("via"))


def merge_hits(*lists: DataFrame) -> DataFrame:
    """Hits of several lists: scores added, provenance united."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.groupBy("concept_id").agg(F.sum("score").alias("score"), F.max("lexical_rank").alias("lexical_rank"), F.max("dense_rank").alias("dense_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"))


def compact_search(concepts: DataFrame, embeddings: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], workspace: str, query: str, query_vector: DataFrame, k: int = 8, steps: int = 3, see: Visibility = Visibility(), normal=S.nfkc) -> DataFrame:
    """Seeds by text and vector, fused, and what they lead to: concept_id, score, lexical_rank, dense_rank, via; the k best.

    The five best seeds are expanded in each of steps - 1 steps, always the same ones, so the steps' weights are summed
    beforehand. Expanded concepts can outrank seeds. Without seeds the result is empty. edges: a table, or what gives the edges
    of the seeds (concept_id), so that no others are made.
    """
    seen = graph.visible(concepts, workspace, list(see.domains), see.with_global).filter("status = 'active'")
    dense = concept_hits(dense_topk(embeddings, concepts, query_vector, workspace, k, see))
    seeds = hybrid_seed(lexical_rank(seen, query, k), dense, k).withColumn("via", F.array(F.lit("hybrid_seed")))
    if steps <= 1:
        return seeds
    seeds = vectors.checkpointed(seeds)  # at most k rows, read several times
    first = seeds.orderBy(F.desc("score"), "concept_id").limit(SEEDS).select("concept_id")
    edges = edges(first) if callable(edges) else edges
    weight = step_weight(steps)
    forward = forward_expand(first, edges, concepts, workspace, weight, see)
    reverse = reverse_expand(first, concepts, workspace, weight * REVERSE, see, normal)
    return merge_hits(seeds, forward, reverse).orderBy(F.desc("score"), "concept_id").limit(k)


def pseudo_scores(hits: DataFrame) -> DataFrame:
    """Hits in the shape of rank(): channel scores from ranks, recency 1."""
    part = lambda c: F.coalesce(1.0 / (F.col(c) + 1), F.lit(0.0))
    return hits.select("concept_id", "score", part("dense_rank").alias("semantic_score"), part("lexical_rank").alias("entity_score"), F.lit(1.0).alias("recency"))


def provenance(hits: DataFrame) -> DataFrame:
    """A line for each hit: where it came from."""
    return hits.select("concept_id", "score", F.format_string("%s (score %.4f, via: %s)", "concept_id", "score", F.array_join("via", ", ")).alias("line"))


# ---- the entity channel and the dual rank ----


def query_entities(query: Column, vocabulary: list[str] | None = None, normal=S.nfkc) -> Column:
    """Entity keys that a query names, in order, each once. Parts stand between characters that are no letters, digits,
    underscores or hyphens. A part that is not ASCII and no known key as a whole is cut by the known keys in it, the longest
    first; without a known one it stays whole."""
    parts = F.filter(F.split(query, r"[^\p{IsAlphabetic}\p{N}_\-\x{80}-\x{10FFFF}]+"), lambda p: F.char_length(p) >= 2)
    if normal is None:
        keys = F.transform(parts, lambda p: S.key_light(p, None))
    else:  # a Python function can't run inside transform(), so the parts go through it as one text
        keys = F.transform(F.split(normal(F.array_join(parts, "\n")), "\n"), lambda p: S.key_light(p, None))
    keys = F.filter(keys, lambda k: (k != "") & ~k.isin(*vocab.QUERY_STOPWORDS))
    if vocabulary:
        known = F.array(*map(F.lit, vocabulary))
        cut = F.regexp_extract_all
        pattern = F.lit(S.alternation(vocabulary))
        keys = F.flatten(F.transform(keys, lambda k: F.when(F.array_contains(known, k) | k.rlike(r"^[\x00-\x7F]*$"), F.array(k)).otherwise(F.when(F.size(cut(k, pattern, F.lit(0))) > 0, cut(k, pattern, F.lit(0))).otherwise(F.array(k)))))
    return F.array_distinct(keys)


def entity_overlap(wanted: Column, keys: Column) -> Column:
    """Share of a concept's distinct entity keys that the query names; 0 without entities."""
    own = F.array_distinct(keys)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(wanted, own)) / F.size(own)).otherwise(0.0)


def days_between(now: str, anchor: Column) -> Column:
    """Whole seconds from an RFC 3339 time to now, in days, at least 0; null where the anchor is no such time."""
    good = anchor.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    at = F.try_to_timestamp(F.when(good, anchor))
    seconds = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 1000000)
    return F.when(at.isNotNull(), F.greatest(seconds, F.lit(0)) / 86400.0)


def rank(concepts: DataFrame, embeddings: DataFrame, workspace: str, wanted: list[str], query_vector: DataFrame, now: str, see: Visibility = Visibility(), tau: float = 90.0, normal=None) -> DataFrame:
    """Dual-channel ranking: concept_id, score, semantic_score, entity_score, recency. wanted: the query's entity keys.

    Active and disputed concepts count, from elsewhere if visible; vectors without a concept stay with recency 1."""
    dense = dense_topk(embeddings, concepts, query_vector, workspace, DENSE_K, see).filter("source_type = 'concept'").select(F.col("source_id").alias("concept_id"), F.greatest("score", F.lit(0.0)).alias("semantic_score"), F.lit(0.0).alias("entity_score"))
    both = dense
    if wanted:
        own = graph.owners_topk(concepts, workspace, wanted, OWNERS)
        keys = F.transform("related_entities", lambda e: S.key_light(e, normal))
        named = own.select("concept_id", F.lit(0.0).alias("semantic_score"), entity_overlap(F.array(*map(F.lit, wanted)), keys).alias("entity_score"))
        both = dense.union(named)
    scores = both.groupBy("concept_id").agg(F.max("semantic_score").alias("semantic_score"), F.max("entity_score").alias("entity_score"))
    seen = graph.visible(concepts, workspace, list(see.domains), see.with_global).select("concept_id").withColumn("seen", F.lit(True))
    known = concepts.select("concept_id", "status", "successful_recall_count", F.coalesce("last_recalled_at", "created_at").alias("anchor")).join(seen, "concept_id", "left")
    out = scores.join(known, "concept_id", "left").filter("status IS NULL OR (seen AND status IN ('active', 'disputed'))")
    recency = F.when(F.col("status").isNull(), 1.0).otherwise(S.recency(days_between(now, F.col("anchor")), F.col("successful_recall_count"), tau))
    out = out.withColumn("recency", recency)
    return out.select("concept_id", ((F.col("semantic_score") * SEMANTIC + F.col("entity_score") * ENTITY) * F.col("recency")).alias("score"), "semantic_score", "entity_score", "recency")


# ---- the context of an answer ----

SECTIONS = ("user_preferences", "known_facts", "rejected_hypotheses", "task_state", "relevant_entities")
#: Headings of the sections, and what every prompt ends with.
HEADINGS = ("User Preferences", "Known Facts", "Rejected / Doubtful Hypotheses", "Current Task State", "Relevant Entities")
INSTRUCTIONS = ("- Do not treat candidate hypotheses as confirmed facts.", "- Respect rejected hypotheses and user preferences.")
#: Sections in the order in which items are given up.
GIVEN_UP = ("relevant_entities", "task_state", "rejected_hypotheses", "user_preferences", "known_facts")


def section_budgets(intent: str, most: int) -> dict[str, int]:
    """Tokens of each section."""
    available = max(max(most - 250, 0), most // 2)
    return {s: available * p // 100 for s, p in zip(SECTIONS, vocab.INTENT_BUDGETS[intent])}


def sections(concepts: DataFrame) -> DataFrame:
    """The items of each section from ranked concepts (with place, from 0): arrays without repeats, in order. One row.
    The concepts are the few best of one query."""
    c, listed = F.col, lambda x: F.filter(F.coalesce(F.col(x), F.array().cast("array<string>")), lambda i: i != "")
    none = F.array().cast("array<string>")
    summary = F.when(c("definition").isNotNull() & (c("definition") != ""), F.array(F.concat("name", F.lit(": "), "definition"))).otherwise(none)
    doubt = F.when(c("status") == "disputed", F.array(F.concat("name", F.lit(" is disputed")))).otherwise(none)
    rows = concepts.select(
        "place", "name", F.when(c("concept_type") == "preference", listed("known_facts")).otherwise(none).alias("user_preferences"), F.concat(summary, listed("known_facts")).alias("known_facts"),
        F.concat(doubt, listed("rejected_hypotheses")).alias("rejected_hypotheses"), listed("open_questions").alias("task_state"), listed("related_entities").alias("relevant_entities"),
    )
    ordered = lambda s: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", s))), lambda x: x[s]))).alias(s)
    return rows.groupBy().agg(F.min_by("name", "place").alias("current_concept"), *[ordered(s) for s in SECTIONS])


def within(items: Column, budget: int) -> Column:
    """The longest prefix of items whose tokens add up to the budget at most."""
    if budget <= 0:
        return F.array().cast("array<string>")
    used = F.aggregate(items, F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("keep")), lambda a, i: F.when(a.used >= 0, F.when(a.used + S.tokens(i) <= budget, F.struct((a.used + S.tokens(i)).alias("used"), (a.keep + 1).alias("keep"))).otherwise(F.struct(F.lit(-1).cast("long").alias("used"), a.keep.alias("keep")))).otherwise(a), lambda a: a.keep)
    return F.slice(items, 1, used)


@dataclass
class MemoryContext:
    """The context of one answer."""

    workspace: str
    intent: str
    current_concept: str | None = None
    user_preferences: list[str] = field(default_factory=list)
    known_facts: list[str] = field(default_factory=list)
    rejected_hypotheses: list[str] = field(default_factory=list)
    task_state: list[str] = field(default_factory=list)
    relevant_entities: list[str] = field(default_factory=list)

    def prompt(self) -> str:
        lines = ["[Memory Context]", f"Workspace: {self.workspace}"]
        if self.current_concept is not None:
            lines.append(f"Current Concept: {self.current_concept}")
        lines.append(f"Intent: {self.intent}")
        for s, heading in zip(SECTIONS, HEADINGS):
            if items := getattr(self, s):
                lines += [f"\n{heading}:", *(f"- {i}" for i in items)]
        return "\n".join([*lines, "\nInstructions:", *INSTRUCTIONS])

    def tokens(self) -> int:
        return max(1, -(-len(self.prompt()) // 4))

    def shorten(self, most: int) -> None:
        """Gives up items, the least needed section first and its last item first, until the prompt fits."""
        while self.tokens() > most:
            section = next((s for s in GIVEN_UP if getattr(self, s)), None)
            if section is None:
                return
            getattr(self, section).pop()


def build_context(concepts: DataFrame, workspace: str, intent: str, most: int = 1500) -> DataFrame:
    """Ranked concepts (with place) as one context: its sections as arrays, prompt and token_count. One row."""
    budgets = section_budgets(intent, most)
    cut = sections(concepts).select("current_concept", *[within(F.col(s), budgets[s]).alias(s) for s in SECTIONS])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                context = MemoryContext(workspace, intent, r.current_concept, *[list(getattr(r, s)) for s in SECTIONS])
                context.shorten(most)
                rows.append([workspace, intent, context.current_concept, *[getattr(context, s) for s in SECTIONS], context.prompt(), context.tokens()])
            yield pd.DataFrame(rows, columns=["workspace_id", "intent", "current_concept", *SECTIONS, "prompt", "token_count"])

    return cut.mapInPandas(finish, "workspace_id string, intent string, current_concept string, " + ", ".join(f"{s} array<string>" for s in SECTIONS) + ", prompt string, token_count long")


def best_concepts(scores: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """The concepts of the k best scores with their place from 0; scores without a concept take a place but give no row."""
    top = ranked(scores.select("concept_id", "score"), "concept_id", k).select("concept_id", F.col("rank").alias("place"))
    return concepts.join(F.broadcast(top), "concept_id")  # at most k rows


def recalled(concepts: DataFrame, k: int = 3) -> DataFrame:
    """The concepts whose recall is recorded, of those that made a context: the first k."""
    return concepts.orderBy("place").limit(k).select("concept_id")
