"""Tables in the shared folder of the cluster, and small helpers that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Lets Spark delete the shuffle files of a query when the query ends; runtime setting of the session.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in one process (local mode, as in tests) gets a temporary folder; on a cluster it
    is an error, as executors do not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cargolens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, path: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    Shuffle files of the query that wrote it go at its end, as the table replaces them. Tables lie in one folder of
    the application, which goes when it ends; ``dropped`` deletes one earlier.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    system, path = _path(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    where, was = f"{folder}/{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(where)
    finally:
        spark.conf.set(CLEANUP, was)
    _WRITTEN.append(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._shared_table = where
    return out


#: Tables of this process that are not dropped yet.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, where: str) -> None:
    system, path = _path(spark, where)
    system.delete(path, True)
    _WRITTEN.remove(where)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if df._shared_table in _WRITTEN:
            _delete(df.sparkSession, df._shared_table)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a table; the tables that were written on the way to it are deleted."""
    before = set(_WRITTEN)
    out = written(make())
    for where in [x for x in _WRITTEN if x not in before and x != out._shared_table]:
        _delete(out.sparkSession, where)
    return out


def with_package(df: DataFrame) -> DataFrame:
    """Lets Python workers of this session import the package where it is not installed but lies in a folder of each machine."""
    environment, here = df.sparkSession.sparkContext.environment, str(Path(__file__).parents[2])
    known = environment.get("PYTHONPATH", "")
    if here not in known.split(":"):
        environment["PYTHONPATH"] = f"{here}:{known}".rstrip(":")
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike ``lower``."""
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
