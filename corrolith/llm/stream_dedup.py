"""Exact deduplication over disk-backed keyed state of a structured stream.

A stream over (digest, stable id, content locator) rows keeps one state entry for each digest, in a RocksDB state store,
without watermark or expiry: the largest stable identifier with the locator of its row, and the number of rows. Each
micro-batch writes the entries that it changed to the shared folder under its batch number, so a repeated batch overwrites
itself; the newest entry of a digest is its state. Whole bytes are then compared among all rows of every digest that was
hit more than once; rows that share a digest but not the bytes (a collision) are grouped by their bytes instead.

Only DataFrame functions run here; the stream's sink is a callback on the driver that starts a write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import ascii_lower, fresh, is_file_scan, new_path, written

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each state store takes 4 MB of disk for its first log, however small the state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Largest list of digests (32 bytes each) that is broadcast to pick the rows whose bytes are compared; a longer one is joined.
BROADCAST_DIGESTS = 500_000


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def located(docs: DataFrame, locator: str) -> DataFrame:
    """docs with the column locator, a struct of file and row that tells all rows apart.

    Rows of a plain scan of files are located where they lie. Any other rows (made in memory, joined, exploded, united) are
    first written to the shared folder, as their files' places would be missing or repeated.
    """

    def at(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias(locator))

    if is_file_scan(docs):
        try:
            return at(docs)
        except AnalysisException:
            pass  # a source that has no row numbers
    return at(written(docs, "dedup-rows"))


def fold_stream(keyed: DataFrame, path: str, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """State after a stream over the files at path, with the schema of keyed (digest, stable, locator): one row per digest
    with stable, locator (of the row with the largest stable) and n. Any bytes_per_trigger gives the same state."""
    spark = keyed.sparkSession
    stream = spark.readStream.schema(keyed.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
    state = stream.groupBy("digest").agg(F.max(F.struct("stable", "locator")).alias("last"), F.count(F.lit(1)).alias("n"))
    out, marks = new_path(spark, "dedup-state"), new_path(spark, "dedup-stream")

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    entries = spark.read.parquet(out)
    newest = entries.groupBy("digest").agg(F.max_by(F.struct("last", "n"), "batch").alias("e"))
    return newest.select("digest", "e.last.stable", "e.last.locator", "e.n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_trigger: int = 64 << 30, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size long, kept boolean, text_sha256, locator.

    Texts are equal when identical after lower-casing A-Z, however long; null counts as empty, and empty texts are equal to
    each other. Of a group the row with the largest doc_id stays; a null doc_id comes before any other, and of rows that
    share the largest one (repeated rows) exactly one stays. group_size counts rows. An empty table gives an empty result.
    Other columns are not read, so they may have any names. locator tells where the row lies.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return _dedup(located(own, "locator"), bytes_per_trigger, digest)


def _dedup(rows: DataFrame, bytes_per_trigger: int, digest: Callable[[Column], Column]) -> DataFrame:
    """exact_dedup() of rows with doc_id, text and locator."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", "locator", ascii_lower(F.col("text")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    exact = digest is sha256
    path = new_path(spark, "dedup-keys")
    keys = rows.select("digest", F.col("doc_id").alias("stable"), "locator", *([] if exact else [F.sha2("body", 256).alias("sha")]))
    keys.write.option("compression", "zstd").parquet(path)
    keyed = spark.read.schema(keys.schema).parquet(path)
    state = written(fold_stream(keyed, path, bytes_per_trigger), "dedup-final") if not keyed.isEmpty() else spark.createDataFrame([], "digest binary, stable long, locator struct<file: string, row: bigint>, n long")
    hit = state.filter("n > 1")
    few = hit.count() <= BROADCAST_DIGESTS
    wanted = F.broadcast(hit.select("digest")) if few else hit.select("digest")
    members = rows.join(wanted, "digest", "left_semi")
    collided = written(members.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"), "dedup-collided")
    groups = hit.select("digest", F.col("stable").alias("keep_id"), F.col("locator").alias("keep_at"), F.col("n").alias("group_size"))
    told = keyed.withColumnRenamed("stable", "doc_id")
    sha = F.lower(F.hex("digest")) if exact else F.col("sha")
    alone = F.col("keep_at").isNull()
    columns = ["doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep_at") == F.col("locator"))).alias("kept"), sha.alias("text_sha256"), "locator"]
    if collided.isEmpty():
        return told.join(groups, "digest", "left").select(*columns)
    clear = told.join(collided, "digest", "left_anti").join(groups, "digest", "left").select(*columns)
    mixed = rows.join(F.broadcast(collided) if few else collided, "digest", "left_semi")
    by_bytes = mixed.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    apart = mixed.join(by_bytes, ["digest", "body"]).select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.locator") == F.col("locator")).alias("kept"), F.sha2("body", 256).alias("text_sha256"), "locator")
    return clear.union(apart)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, whatever their names."""
    place, key = fresh(docs.columns, "__locator", "__key")
    whole = located(docs, place)
    rows = whole.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(place).alias("locator"))
    kept = _dedup(rows, 64 << 30, sha256).filter("kept").select(F.col("locator").alias(key))
    return whole.join(kept, whole[place] == kept[key], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
