"""Session files as rows of raw memory. files: source_ref, workspace_id, content (a whole file as one row).

Every row has memory_id, workspace_id, session_id, role, content, source_type, source_ref, extraction_version, created_at.
Ids are digests of the file and the place in it, so reading a file again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrolith.functions.scalars import session_key, trimmed

RAW = ("memory_id", "workspace_id", "session_id", "role", "content", "source_type", "source_ref", "extraction_version", "created_at")
_SESSION = "session_id string, date string, messages array<struct<role: string, content: string>>"


def read_files(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Whole text files below a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_ref"), F.lit(workspace).alias("workspace_id"), F.col("value").alias("content"))


def _rows(df: DataFrame, kind: str, now: str) -> DataFrame:
    at = F.when(F.coalesce("date", F.lit("")) == "", F.lit(now)).otherwise(F.col("date"))
    return df.select(
        F.md5(F.concat_ws("\x00", "workspace_id", "source_ref", F.col("place").cast("string"))).alias("memory_id"), "workspace_id", "session_id", "role", "content",
        F.lit(kind).alias("source_type"), "source_ref", F.lit(None).cast("string").alias("extraction_version"), at.alias("created_at"),
    )


def is_json(content: Column) -> Column:
    return F.ltrim(content).startswith("{") & F.contains(content, F.lit('"session_id"'))


def json_sessions(files: DataFrame, now: str) -> DataFrame:
    """One row per message of a JSON session {session_id, date, messages}; all share its date, or now. A file that is no
    such session is an error; one without content gives no rows."""
    parsed = files.withColumn("s", F.from_json("content", _SESSION, {"mode": "PERMISSIVE"}))
    bad = F.col("content").isNotNull() & (F.col("s").isNull() | F.col("s.session_id").isNull() | F.col("s.messages").isNull())
    whole = F.when(bad, F.raise_error(F.concat(F.lit("no JSON session: "), "source_ref")).cast(parsed.schema["s"].dataType)).otherwise(F.col("s"))
    parsed = parsed.withColumn("s", whole)
    rows = parsed.select("source_ref", "workspace_id", F.col("s.session_id").alias("session_id"), F.col("s.date").alias("date"), F.posexplode("s.messages").alias("place", "m"))
    return _rows(rows.select("source_ref", "workspace_id", "session_id", "date", "place", F.col("m.role").alias("role"), F.col("m.content").alias("content")), "session_file", now)


def is_journal(content: Column) -> Column:
    return content.startswith("# Journal")


def journal_sections(files: DataFrame, now: str) -> DataFrame:
    """One row per section of a Markdown journal that has text. `## Session N: title` starts a session and its section
    `header`, `### X` a section named x, `---` ends one; `**Date**: v` dates what ends after it in the session, else now.
    Text before the first session is ignored. A file is read by one task."""
    lines = files.select("source_ref", "workspace_id", F.posexplode(F.split(F.regexp_replace("content", "\r?\n$", ""), "\r?\n")).alias("n", "line"))
    t = trimmed(F.col("line"))
    lines = lines.withColumn("t", t)
    title = trimmed(F.regexp_replace("t", "^#+", ""))
    session, section, rule = F.col("t").startswith("## Session "), F.col("t").startswith("### "), F.col("t") == "---"
    date = F.when(session, F.lit("")).when(~section & F.col("t").rlike(r"^\*\*Date\*\*:\s*.+$"), trimmed(F.regexp_extract("t", r"^\*\*Date\*\*:\s*(.+)$", 1)))
    marked = lines.select(
        "source_ref", "workspace_id", "n", (session | section | rule).cast("int").alias("cut"), F.when(session, session_key(title)).alias("id"),
        F.when(session, "header").when(section, F.lower(title)).alias("name"), date.alias("date"), F.when(session, title).when(~section & ~rule, F.col("line")).alias("text"),
    )
    upto = Window.partitionBy("workspace_id", "source_ref").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    told = marked.select("source_ref", "workspace_id", "n", "text", F.sum("cut").over(upto).alias("place"), last("id").alias("session_id"), last("name").alias("role"), last("date").alias("date"))
    told = told.filter("session_id IS NOT NULL")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("n", "text")))), lambda x: x["text"])
    rows = told.groupBy("workspace_id", "source_ref", "place", "session_id", "role").agg(F.max_by("date", "n").alias("date"), trimmed(F.array_join(texts, "\n")).alias("content"))
    return _rows(rows.filter("content <> ''"), "journal", now)


@dataclass(frozen=True)
class SessionParser:
    """A format: which contents are of it, and how files of it become rows."""

    name: str
    can_parse: Callable[[Column], Column]
    parse: Callable[[DataFrame, str], DataFrame]


PARSERS = (SessionParser("journal", is_journal, journal_sections), SessionParser("json", is_json, json_sessions))


def format_of(content: Column, parsers: tuple[SessionParser, ...] = PARSERS) -> Column:
    """The name of the first parser that takes the content; null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(parsers):
        out = F.when(p.can_parse(content), p.name).otherwise(out)
    return out


def parse_sessions(files: DataFrame, now: str, parsers: tuple[SessionParser, ...] = PARSERS) -> tuple[DataFrame, DataFrame]:
    """Rows of all files by their formats, and the files of no known format."""
    known = files.withColumn("__format", format_of(F.col("content"), parsers))
    rows = None
    for p in parsers:
        # the content is taken away as well, for the order in which conditions are evaluated is not given
        own = known.filter(F.col("__format") == p.name).withColumn("content", F.when(F.col("__format") == p.name, F.col("content")))
        part = p.parse(own.drop("__format"), now)
        rows = part if rows is None else rows.unionByName(part)
    return rows, known.filter("__format IS NULL").drop("__format")
