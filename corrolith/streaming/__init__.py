"""Streams over the ledger: messages once each, and evidence folded as it comes. These go beyond batch runs; their results on
a finished input are those of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith import vocab
from corrolith.functions.scalars import looked_up
from corrolith.operators.history import ledger


def fresh_messages(raw: DataFrame, time: str = "created_ts", delay: str = "1 day") -> DataFrame:
    """Messages of a stream, each memory_id once within the delay."""
    return raw.withWatermark(time, delay).dropDuplicatesWithinWatermark(["memory_id"])


def evidence_totals(events: DataFrame) -> DataFrame:
    """Alpha, beta and count of each edge over a stream of evidence, as graph.fold_edges starts them."""
    da = looked_up(F.col("evidence"), {k: a for k, (a, _) in vocab.EVIDENCE.items()}, 0.0)
    db = looked_up(F.col("evidence"), {k: b for k, (_, b) in vocab.EVIDENCE.items()}, 0.0)
    return events.groupBy("workspace_id", "src", "dst", "relation_type").agg((1 + F.sum(da)).alias("alpha"), (1 + F.sum(db)).alias("beta"), F.sum(((da + db) != 0).cast("long")).alias("evidence_count"))


def feedback_windows(feedback: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Durable feedback of a stream by concept and window: how often, and what it adds to alpha and beta. Feedback that comes
    later than the delay is left out."""
    rows = ledger(feedback.withWatermark(time, delay))
    return rows.groupBy(F.window(time, width), "concept_id").agg(F.count(F.lit(1)).alias("n"), F.sum("alpha_delta").alias("alpha"), F.sum("beta_delta").alias("beta"))


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Writes what is there by micro-batches and returns. A batch that is repeated has its number again, so a write that
    overwrites by number takes each once."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
