"""Mixing of sources to target weights.

Every row gets a hash-random key. Keys are cut into ranges of equal width, as many in each source as its rows ask for, so a
hot source lies in many ranges and sorting happens inside ranges only. Sums of word counts by range give each range the
words that lie before it in its source, and a running sum inside the range completes the distributed prefix sum. Each
source is cut at its exact budget: whole epochs first, then the rows in key order up to the remaining words, the last of
them in part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrolith.llm.common import WS, fresh, partitions, written

#: Hash keys are the first 40 bits of an MD5 digest.
KEY_BITS = 40


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order, null last; share is the mix's size as a part of all sizes; no
    source is used more than epochs times."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    epochs: int = 2


def word_count(text: str):
    """Number of runs of other characters than white space; null: 0."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(F.col(text), f"^[{WS}]+", ""), f"[^{WS}]+[{WS}]*", "x")), F.lit(0)).cast("long")


def hash_key(number: Column, text: Column) -> Column:
    """The hash-random key of a row, from its id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit(":"), text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes: source, source_size, rows, one row per source. Adds target.

    A null source is one source, the last; sources without words get target 0; no source gives no row. Targets share the
    mix by weight; those above their cap (epochs times the size) stop there and the excess is shared again
    among the others until none is above. Only sums come to the driver.
    """
    ranked = _numbered(sizes)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in mix.weights]), (F.pmod("place", F.lit(len(mix.weights))) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * mix.epochs), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words for each unit of weight
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        capped, free = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (mix.share * total - capped) / free
        if new == level:
            break
        level = new
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds place, the number of sources before this one. Sources are sorted by ranges; a source's place is the number of
    sources in the ranges before its own, of which there are as many as partitions, and its number inside."""
    order = ["__null", "source"]
    ranged = sizes.withColumn("__null", F.col("source").isNull()).orderBy(*order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "mix-order")
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(starts, "__range").withColumn("place", F.col("__inside") + F.col("__before")).drop("__null", "__range", "__inside", "__before")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size long, source_size long, target double, taken long.

    taken is the number of words that the mix takes of the row, repeats counted: epochs times the size, and in the row at
    which the budget ends a part of it. Null texts have size 0, null sources are one source, repeated rows count each.
    A source without words has target 0. Whole texts are counted, however long; an empty table gives none; other columns
    are not read. The result depends on the rows alone, not on their order or partitions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = hash_key(F.col(id_col).cast("long"), text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), text.alias("text"))
    rows = written(rows.select("doc_id", "source", "key", word_count("text").alias("size")), "mix-rows")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), mix), "mix-targets")
    # a range holds about an eighth of a shuffle partition
    n = rows.count()
    span = max(1, n // (8 * partitions(docs.sparkSession)))
    told = targets.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("rows") / span)).cast("long")).withColumnRenamed("source", "__source")
    with_range = rows.join(told, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "rows")
    with_range = with_range.withColumn("range", F.floor(F.col("key") * F.col("ranges") / F.lit(float(1 << KEY_BITS))).cast("long"))
    sums = with_range.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("__source"), F.col("range").alias("__range"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = with_range.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("start") - F.col("inner"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), "key")


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, whatever their names.

    A row at which a budget ends comes once more if the mix takes at least half of it. Rows without words are not taken.
    Null ids and sources are taken like others; rows that share id, source and text are taken alike. An empty table gives
    none.
    """
    names = fresh(docs.columns, "__id", "__source", "__key", "__copies", "__copy")
    i, s, k, many, copy = names
    taken = mix_sources(docs, mix, id_col, text_col, source_col).filter("size > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    copies = taken.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("key").alias(k), times.alias(many)).filter(F.col(many) > 0).groupBy(i, s, k).agg(F.max(many).alias(many))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number, source = F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string")
    on = number.eqNullSafe(copies[i]) & source.eqNullSafe(copies[s]) & (hash_key(number, text) == copies[k])
    return docs.join(copies, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*[F.col(f"`{c}`") for c in docs.columns])
