"""Artefacts kept under what made them: models, graphs and other tables that many jobs need.

An artefact's key is a hash of its parameters and of the files its tables come from, with their sizes and times of
change. A job that needs it looks the key up before it makes anything, so that each is made once per data
set, whichever job comes first; changed files or parameters give another key. Artefacts are written beside and
then renamed, so a job that dies leaves none half made, and of two that make the same one the first to
finish is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.session import cut_lineage, shared_dir


def models_dir(spark: SparkSession) -> str:
    """The folder of all artefacts. They outlive the session, if its shared folder does."""
    return f"{shared_dir(spark).rstrip('/')}/stockloom-models"


def fingerprint(frames: list[DataFrame], **parameters) -> str | None:
    """A key for what is made of ``frames`` with ``parameters``; None if a table doesn't come from files.

    Spark lists the files; the driver holds their names, but for each table only a count, a size and a
    hash of names, sizes and times comes back.
    """
    about = []
    for frame in frames:
        files = frame.inputFiles()
        if not files:
            return None
        listed = frame.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        row = listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
        about.append([*row, frame.columns, frame._jdf.queryExecution().analyzed().canonicalized().schema().json()])
    return hashlib.sha256(json.dumps([about, sorted(parameters.items())], default=str).encode()).hexdigest()[:32]


def _paths(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(spark: SparkSession, kind: str, key: str | None, load: Callable[[SparkSession, str], Any], make: Callable[[], Any]):
    """The artefact of a kind and key: loaded if there is one, else made and saved (``save(spark, path)``). Without a key it is made anew."""
    if key is None:
        return make()
    path = f"{models_dir(spark)}/{kind}-{key}"
    final, files = _paths(spark, path)
    if files.exists(final):
        return load(spark, path)
    made = make()
    draft = f"{models_dir(spark)}/draft-{uuid.uuid4().hex}"
    made.save(spark, draft)
    if files.exists(final) or not files.rename(_paths(spark, draft)[0], final):
        files.delete(_paths(spark, draft)[0], True)  # another job was faster
    return load(spark, path)


@dataclass(frozen=True)
class Table:
    """A table to be kept."""

    rows: DataFrame

    def save(self, spark: SparkSession, path: str) -> str:
        self.rows.write.mode("overwrite").parquet(path)
        return path


def keep_table(spark: SparkSession, kind: str, key: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept like other artefacts; without a key it is stored for this session only."""
    load = lambda session, path: Table(session.read.parquet(path))
    return keep(spark, kind, key, load, lambda: Table(make() if key else cut_lineage(make()))).rows


def names(spark: SparkSession) -> set[str]:
    """The artefacts there are, by kind and key."""
    folder, files = _paths(spark, models_dir(spark))
    return {x.getPath().getName() for x in files.listStatus(folder)} if files.exists(folder) else set()


def forget(spark: SparkSession) -> None:
    """Delete all artefacts."""
    folder, files = _paths(spark, models_dir(spark))
    files.delete(folder, True)
