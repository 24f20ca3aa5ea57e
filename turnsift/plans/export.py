"""SNK12, SNK13: the redacted corpus as JSON lines in order, kept only if an audit of what
was written finds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..audit.detect import findings
from ..functions.redact import redact_fields
from ..operators.search import with_sessions

SHOWN = ("project", "title", "tool", "target", "text")
MOST_SHOWN, ID_SHOWN = 1200, 8


def redacted_corpus(turns: DataFrame, sessions: DataFrame, now: float, account: str | None = None) -> DataFrame:
    """One row a turn, with its session's values.  Free texts are redacted, then cut; ids
    are shortened, and times become ages in whole days (null: undated), so that the same
    corpus is the same text on another day of the same age."""
    age = F.when(F.col("ts") != 0, F.bround((F.lit(float(now)) - F.col("ts")) / 86400.0).cast("long"))
    joined = with_sessions(turns, sessions).select("session_id", "turn_id", F.substring("session_id", 1, ID_SHOWN).alias("session"), "source", "seq", age.alias("age_days"), "kind", *SHOWN)
    return redact_fields(joined, {c: F.col(c) for c in SHOWN}, account).withColumn("text", F.substring("text", 1, MOST_SHOWN))


def export_corpus(turns: DataFrame, sessions: DataFrame, path: str, now: float, account: str | None = None) -> int:
    """The number of findings; where it is none, the corpus is at ``path``, its files and
    their lines by (session_id, seq).

    Redaction runs once: what it gave is written beside ``path``, audited from there, and
    renamed or removed.
    """
    spark = turns.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if fs.exists(place):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    corpus = redacted_corpus(turns, sessions, now, account).repartitionByRange("session_id", "seq", "turn_id").sortWithinPartitions("session_id", "seq", "turn_id").drop("session_id", "turn_id")
    corpus.write.option("ignoreNullFields", "false").json(staged)
    written = spark.read.schema(corpus.schema).json(staged)
    found = findings(written.select("session", F.concat_ws("\n", *SHOWN).alias("text")), "session").count()
    if found:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    else:
        fs.mkdirs(place.getParent())
        fs.rename(jvm.org.apache.hadoop.fs.Path(staged), place)
    return found
