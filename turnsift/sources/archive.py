"""Where transcripts lie, and their lines as a DataFrame (SRC1-SRC5)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCES


@dataclass(frozen=True)
class Source:
    """A place for one dialect.  A missing one is reported, never read as empty."""

    name: str
    root: str
    exists: bool


# Places below the home directory, and below the root of an archive.
HOME_PLACES = {"claude_code": ".claude/projects", "codex": ".codex/sessions", "claude_prompts": ".claude/history.jsonl"}
ARCHIVE_PLACES = {"claude_code": "claude-projects", "codex": "codex-sessions", "claude_prompts": "claude-history.jsonl"}
VARIABLES = {name: f"TURNSIFT_{name.upper()}" for name in SOURCES}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def roots(archive: str | None = None) -> dict[str, str]:
    """SRC2, SRC3: an archive's places, or those of the user, each open to a variable."""
    if archive:
        return {name: f"{archive.rstrip('/')}/{ARCHIVE_PLACES[name]}" for name in SOURCES}
    home = os.path.expanduser("~")
    return {name: os.environ.get(VARIABLES[name]) or f"{home}/{HOME_PLACES[name]}" for name in SOURCES}


def discover(spark: SparkSession, archive: str | None = None) -> list[Source]:
    """SRC1: the sources in their fixed order, by way of Spark's own file systems."""
    return [Source(name, root, _exists(spark, root)) for name, root in roots(archive).items()]


def bare(raw: Column) -> Column:
    """A line without the white space and separators around it."""
    return F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def file_path() -> Column:
    """The file a row was read from.  It comes as a URI: percent signs are escapes there,
    plus signs are not."""
    return local_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def split_lines(texts: DataFrame, source: str) -> DataFrame:
    """source, path, start and raw of what a text reader gave, a stream's included."""
    found = texts.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value"))
    return found.select(F.lit(source).alias("source"), "path", "start", bare(F.col("value")).alias("raw"))


def lines(spark: SparkSession, source: Source) -> DataFrame:
    """SRC4, SRC5: path, start, at and raw of each line, blank ones (empty) included.

    Files are split like any text.  start is the place of the split in its file; at grows
    by one from line to line of a split; ``segments.number_lines`` makes line numbers of
    them, so no file passes through one task.  Bytes that are not UTF-8 become replacement
    characters; CRLF, CR and LF end a line; a file that can't be read is passed over with
    a warning (SRC9).
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if not source.root.endswith(".jsonl"):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    return split_lines(reader.text(source.root), source.name).select("source", "path", "start", F.monotonically_increasing_id().alias("at"), "raw")
