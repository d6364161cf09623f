"""Scalar functions as columns: keys, keyword classes, evidence arithmetic, vectors. All but NFKC run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corrolith import vocab


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def key_light(text: Column, normal=nfkc) -> Column:
    """Entity key: trimmed, NFKC, lower case, runs of spaces, hyphens and underscores as one underscore, none at the end."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    lowered = F.lower(normal(trimmed) if normal else trimmed)
    return F.regexp_replace(F.regexp_replace(lowered, "[ _-]+", "_"), "_+$", "")


def predicate_key(text: Column) -> Column:
    """The canonical predicate of a spelling; unknown ones stay, lower-cased and joined by underscores."""
    key = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), " ", "_")
    found = F.lit(None).cast("string")
    for name, spellings in vocab.PREDICATES.items():
        found = F.when(key.isin(*spellings), name).otherwise(found)
    return F.coalesce(found, key)


def has_keyword(text: Column, word: str) -> Column:
    """ASCII words and single characters need neighbours that are no word characters; others match anywhere."""
    if word.isascii() or len(word) == 1:
        edge = r"[\p{IsAlphabetic}\p{N}_-]"
        return text.rlike(rf"(?<!{edge}){re.escape(word)}(?!{edge})")
    return text.contains(word)


def first_class(text: Column, tables, otherwise: str) -> Column:
    """The class of the first table that has a keyword in the text."""
    lowered = F.lower(text)
    out = F.lit(otherwise)
    for name, words in reversed(tables):
        hit = F.lit(False)
        for w in words:
            hit = hit | has_keyword(lowered, w)
        out = F.when(hit, name).otherwise(out)
    return out


def feedback_class(text: Column) -> Column:
    return first_class(text, vocab.FEEDBACK_WORDS, "general")


def persistence_class(text: Column) -> Column:
    return first_class(text, vocab.PERSISTENCE_WORDS, "scenario_specific")


def intent_class(text: Column) -> Column:
    return first_class(text, vocab.INTENT_WORDS, "general_query")


def is_correction(text: Column) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for w in vocab.CORRECTION_CUES:
        hit = hit | has_keyword(lowered, w)
    return hit


def looked_up(key: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def fact_confidence(alpha: str = "evidence_alpha", beta: str = "evidence_beta") -> Column:
    return F.col(alpha) / (F.col(alpha) + F.col(beta))


def effective_confidence() -> Column:
    return F.col("extraction_confidence") * fact_confidence()


def heterogeneous_weight(delta: Column, source: Column, reuse: Column) -> Column:
    """Evidence scaled by the source's trust and, up to twice, by how often it is reused."""
    n = F.greatest(reuse, F.lit(1))
    return delta * looked_up(source, vocab.SOURCE_FACTOR, 1.0) * F.least(1.0 + 0.25 * (n - 1), F.lit(2.0))


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / 4.0)).cast("long")


def recency(days: Column, successes: Column, tau: float = 90.0) -> Column:
    """Exponential decay, slowed by successful recalls; 1 where the days are unknown or tau is not positive."""
    if tau <= 0:
        return F.lit(1.0)
    rate = (1.0 / tau) / (1.0 + 0.5 * F.greatest(successes, F.lit(0)))
    return F.coalesce(F.exp(-rate * F.greatest(days, F.lit(0.0))), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty, or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def alternation(words: list[str]) -> str:
    """A pattern that matches the longest of the words (of two characters or more) at each place."""
    return "|".join(re.escape(w) for w in sorted((w for w in words if len(w) >= 2), key=lambda w: (-len(w.encode()), w))) or "(?!)"


def entity_key(text: pd.Series) -> pd.Series:
    """The aggressive entity key: as key_light, but known endings of names are dropped too, never the whole name."""

    def one(t: str | None) -> str | None:
        if t is None or not t.strip():
            return None if t is None else ""
        s = unicodedata.normalize("NFKC", t.strip())
        s = next((s[: -len(e)] for e in vocab.PASCAL_ENDINGS if s.endswith(e) and len(s) > len(e)), s)
        s = re.sub("_+$", "", re.sub("[ _-]+", "_", s.lower()))
        while True:
            cut = next((s[: -len(e)] for e in vocab.JOINED_ENDINGS if s.endswith(e) and len(s) > len(e) and not s[: -len(e)].endswith("_")), None)
            if cut is None:
                break
            s = cut
        return next((s[: -len(e)] for e in vocab.BARE_ENDINGS if s.endswith(e) and len(s) > len(e)), s)

    return text.map(one)


key_aggressive = F.pandas_udf(entity_key, StringType())


def session_key(header: Column) -> Column:
    """session_N for a heading that starts with `Session N`, else the heading."""
    number = F.regexp_extract(header, r"(?i)^session\s+(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("session_"), number)).otherwise(header)


def without_fences(reply: Column) -> Column:
    """A reply without the code fence around it."""
    s = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^(```json|```)+\n*", ""), "`+$", ""), r"^\s+|\s+$", "")
    return F.when(s.startswith("```"), inner).otherwise(s)


def canonical_pair(a: Column, b: Column, kind: Column) -> tuple[Column, Column]:
    """The ends of an edge as they are stored: in order of their ids, unless the type has a direction."""
    keep = kind.isin(*vocab.DIRECTED)
    return F.when(keep, a).otherwise(F.least(a, b)), F.when(keep, b).otherwise(F.greatest(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine over the shorter length, between 0 and 2; 1 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when((n > 0) & (size > 0), 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(1.0)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def entity_set(subject: Column, obj: Column) -> Column:
    """Trimmed subject and object, each once, without blank ones."""
    return F.filter(F.array_distinct(F.array(trimmed(subject), trimmed(obj))), lambda x: x.isNotNull() & (x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def combined_distance(distance: Column, overlap: Column) -> Column:
    """A distance shortened by up to half where entities are shared."""
    return F.when(overlap > 0, distance * (1.0 - 0.5 * overlap)).otherwise(distance)


def appended(items: Column, item: Column) -> Column:
    """items with item at the end, unless it is among them."""
    held = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(held, item), held).otherwise(F.array_append(held, item))


def merged_entities(entities: Column, text: Column, normal=nfkc) -> Column:
    """entities with the keys that a text names and that they lack; a key that the text repeats comes as often."""
    held = F.coalesce(entities, F.array().cast("array<string>"))
    known = F.transform(held, lambda e: key_light(e, None))
    parts = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}_\-\x{80}-\x{10FFFF}]+"), lambda p: F.char_length(p) >= 2)
    whole = F.array_join(parts, "\n")
    keys = F.transform(F.split(normal(whole) if normal else whole, "\n"), lambda p: key_light(p, None))
    return F.concat(held, F.filter(keys, lambda k: (k != "") & ~k.isin(*vocab.FEEDBACK_STOPWORDS) & ~F.array_contains(known, k)))


def correction_signal(text: Column, implicit: bool = True) -> Column:
    """What a message says about memory: its scope and whether it lasts; null for a message that corrects nothing, unless it
    is said to the memory itself."""
    scope = persistence_class(text)
    signal = F.struct(text.alias("text"), scope.alias("scope"), F.lit(implicit).alias("implicit"), (scope != "task_temporary").alias("durable"))
    return F.when(is_correction(text), signal) if implicit else signal


def days_since(now: Column, created: Column) -> Column:
    """Whole seconds from a time to now in days, at least 0; 0 where the time is unknown."""
    return F.coalesce(F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(created)) / 1000000), F.lit(0)) / 86400.0, F.lit(0.0))


def evidence_seed(source: Column) -> tuple[Column, Column]:
    """Alpha and beta that a row of a source type starts with."""
    first = {s: vocab.EVIDENCE[e] for s, e in vocab.FIRST_EVIDENCE.items()}
    return 1.0 + looked_up(source, {s: a for s, (a, _) in first.items()}, 0.0), 1.0 + looked_up(source, {s: b for s, (_, b) in first.items()}, 0.0)


def known_source(source: Column) -> Column:
    return F.when(source.isin(*vocab.TRUST), source).otherwise("assistant_guess")


def label_hash(text: Column) -> Column:
    """A short name of a text; which one doesn't matter, as long as different texts differ."""
    return F.md5(text)


def tolerant_items(text: Column) -> Column:
    """Items of a serialised list without empty ones; a text that is no such list is one item, none has no items."""
    items = F.from_json(text, "array<string>")
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), empty).when(items.isNotNull() & text.rlike(r"^\s*\["), F.filter(items, lambda i: i.isNotNull() & (i != ""))).otherwise(F.array(text))
