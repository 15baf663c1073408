"""Readers with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cargolens.schemas import FLOWS, GROUND_TRUTH, SHIPMENTS

NULLS = ("", "NULL", "null")


def bulk_load(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of CSV files with a header line, columns by position.

    Fields are read as text, the tokens '', NULL and null become null, then each is cast. Rows with a field that does
    not cast, with too few or too many fields, or without a value that the schema requires are rejected, not errors.
    """
    names = [f.name for f in schema]
    text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))] + [StructField("__bad", StringType())])
    raw = spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").csv(path)
    clean = raw.select(*[F.when(~F.col(f"c{i}").isin(*NULLS), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))], "__bad")
    typed = clean.select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)], "*")
    wrong = F.col("__bad").isNotNull()
    for i, f in enumerate(schema):
        wrong |= F.col(f.name).isNull() & (F.col(f"c{i}").isNotNull() | F.lit(not f.nullable))
    return typed.where(~wrong).select(names), typed.where(wrong).select([f"c{i}" for i in range(len(names))])


def shipments_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHIPMENTS).option("header", True).csv(path)


def truth_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).parquet(path)


def flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Three columns of the wide raw file, by name; the others are not parsed."""
    return spark.read.option("header", True).csv(path).select(FLOWS.names)


def flags_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported flags; names of columns in lower case."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lower() for c in df.columns])


def json_object(spark: SparkSession, path: str, missing_ok: bool = False) -> dict | None:
    """A single small object. None for a missing file, if that is allowed."""
    files = _glob(spark, path)
    if not files:
        if missing_ok:
            return None
        raise FileNotFoundError(path)
    return json.loads("\n".join(r.value for r in spark.read.text(files[0], wholetext=True).limit(1).collect()))


def resolve_flows(spark: SparkSession, folder: str, explicit: str | None = None) -> str | None:
    """The named file, else the newest faf5_*.csv of a folder in any file system that Spark reads, else None."""
    return explicit or next(iter(_glob(spark, f"{folder}/faf5_*.csv")), None)


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in sorted(found, key=lambda f: -f.getModificationTime())]
