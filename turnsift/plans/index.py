"""Files to tables: discover, read, parse, build, write."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources import store
from ..sources.archive import Source, discover, lines
from ..sources.parse import build, emissions, numbered
from ..sources.work import remove, scope


def build_index(spark: SparkSession, path: str, archive: str | None = None, only: Sequence[str] = (), home: str | None = None) -> tuple[dict, list[Source]]:
    """A full rebuild.  Returns the counters and the sources, missing ones included.

    The emissions are written once beside the index and read several times from there.
    """
    store.guard(path)
    began = time.time()
    sources = [s for s in discover(spark, archive) if not only or s.name in only]
    found = None
    for s in sources:
        if s.exists:
            part = emissions(lines(spark, s))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return {"files": 0}, sources
    work = f"{path.rstrip('/')}/work-{uuid.uuid4().hex}"
    found.write.parquet(work)
    emitted = numbered(spark.read.schema(found.schema).parquet(work), f"{work}-splits")
    with scope(spark):
        turns, sessions, counts = build(emitted, home=home if home is not None else os.path.expanduser("~"))
        meta = {r["name"]: r["n"] for r in counts.collect()}
        meta["build_seconds"] = round(time.time() - began, 1)
        store.write(path, turns, sessions, meta)
    remove(spark, work)
    remove(spark, f"{work}-splits")
    return meta, sources


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return store.read(spark, path)
