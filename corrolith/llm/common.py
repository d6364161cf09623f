"""What the operators of this subpackage share: the shared folder, tables written to cut lineage, Arrow batches, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that the contracts call white space.
WS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
BATCH_BYTES = 4 << 20
#: Bytes whose hashes are made at once.
HASH_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one in local mode, where all
    tasks share the driver's disk; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corrolith-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    try:
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is scratch space
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written to the shared folder, so that no later job recomputes them."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_scratch", None)):
            _remove(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only: the meaning of lower() would reach beyond ASCII."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def is_file_scan(df: DataFrame) -> bool:
    """Whether df is a plain scan of files: nothing but projections and filters stand above one relation of files. Only then
    does a place in a file tell all its rows apart."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and len(df.inputFiles()) > 0


def with_place(df: DataFrame, file: str, row: str, name: str) -> DataFrame:
    """df with two long columns that tell its rows apart: a hash of the file that a row lies in, and its number there. Rows
    that don't lie in files are first written to the shared folder. 64 bits suffice to tell files apart, not rows."""

    def at(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))

    if is_file_scan(df):
        try:
            return at(df)
        except AnalysisException:
            pass  # a source without row numbers
    return at(written(df, name))


def small_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where the bytes of text since the last cut reach BATCH_BYTES; a longer text is alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= BATCH_BYTES or batch.num_rows <= 1:
            yield batch
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at] - sizes[at]
            stop = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def map_text(df: DataFrame, schema: str, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """df by Arrow batches of bounded text; make() runs once in each task and returns what turns a batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in small_batches(batches, text):
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible structure."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each ended by a line break; where the words in them start and end; and the number of
    words before each text, with the total at the end. Words stand between white space of ASCII."""
    data = [(t or "").encode() for t in texts]
    body = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum(np.array([len(d) for d in data], np.int64) + 1)[:-1]])
    space = SPACE[body]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    return body, start, end, np.append(np.searchsorted(start, begin), len(start))


def _byte_values() -> np.ndarray:
    """A mixed 64-bit word for each place up to NEAR and each byte."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(NEAR << 8, dtype=np.uint64) + _SHIFT)


#: Places in a word whose values come from a table; later ones are mixed on the spot, by the same rule.
NEAR = 64
_SHIFT = np.uint64(0x9E3779B97F4A7C15)
_VALUES = _byte_values()


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words: mixed sums of mixed pairs (place in the word, byte), so a hash depends on the word alone.
    Bytes are handled in bounded blocks. lower: A-Z count as a-z."""
    out = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(start, start[at] + HASH_BYTES)))
            first, last = start[at], end[stop - 1]
            piece = LOWERED[body[first:last]] if lower else body[first:last]
            s, e = start[at:stop] - first, end[at:stop] - first
            place = np.arange(len(piece)) - np.repeat(s, np.diff(np.append(s, len(piece))))
            far = np.flatnonzero(place >= NEAR)
            value = _VALUES[(np.minimum(place, NEAR - 1) << 8) | piece]
            if len(far):
                value[far] = mixed(((place[far].astype(np.uint64) << np.uint64(8)) | piece[far]) + _SHIFT)
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            out[at:stop] = mixed(running[e] - running[s])
            at = stop
    return out
