"""Writers: tables, CSV exports, JSON objects, provenance, and statements of SQL scripts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from cargolens.schemas import GENERATION_RUNS, TABLES


def run_statements(spark: SparkSession, script: str) -> int:
    """Runs statements split at semicolons; semicolons within literals or comments are not supported."""
    statements = [s.strip() for s in script.split(";") if s.strip()]
    for s in statements:
        spark.sql(s)
    return len(statements)


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def create_tables(spark: SparkSession, schema: str, location: str | None = None) -> None:
    """Makes the schema if it is missing, uses it and puts the six tables in it anew, empty."""
    place = f" LOCATION '{location}'" if location else ""
    run_statements(spark, f"CREATE SCHEMA IF NOT EXISTS {schema}{place}; USE {schema}")
    for name, columns in TABLES.items():
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in columns)
        run_statements(spark, f"DROP TABLE IF EXISTS {name}; CREATE TABLE {name} ({fields}) USING parquet{' PARTITIONED BY (mode)' if name == 'shipments' else ''}")


def store(df: DataFrame, name: str, append: bool = False) -> None:
    """Rows of ``df`` as the table's, or added to them. created_at, where the table has it and ``df`` has not, is the time of writing."""
    spark = df.sparkSession
    table = spark.table(name)
    if "created_at" in table.columns and "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
    if name == "shipments":
        df = df.repartitionByRange("mode", "ship_date", "lane_id").sortWithinPartitions("ship_date", "lane_id")
    df.write.insertInto(name, overwrite=not append)


def save_shipments(ships: DataFrame, path: str) -> None:
    """One folder a mode; within files in the order of date and lane, so that scans skip row groups."""
    ships.repartitionByRange("mode", "ship_date", "lane_id").sortWithinPartitions("ship_date", "lane_id").write.mode("overwrite").partitionBy("mode").parquet(path)


def with_date_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as yyyy-MM-dd."""
    dated = {f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)}
    return df.withColumns(dated) if dated else df


def export_csv(frames: dict[str, DataFrame], folder: str, single: bool = True) -> list[str]:
    """One folder of CSV a frame; as a single file for the small views."""
    paths = []
    for name, df in frames.items():
        out = with_date_text(df)
        (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path := f"{folder}/{name}.csv")
        paths.append(path)
    return paths


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A single small object, in any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(value, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def generation_run(spark: SparkSession, metadata: dict) -> DataFrame:
    """The provenance row of a run; the file is null where metadata has none."""
    row = spark.createDataFrame([tuple(str(v) if (v := metadata.get(f.name)) is not None else None for f in GENERATION_RUNS)], ", ".join(f"{f.name} string" for f in GENERATION_RUNS))
    return row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in GENERATION_RUNS])


def evaluation_report(metrics: DataFrame, metadata: dict) -> dict:
    """Metrics by method with the run's id and source (a few rows)."""
    rows = {r["method"]: {k: v for k, v in r.asDict().items() if k != "method"} for r in metrics.collect()}
    return {"run_id": metadata.get("run_id"), "seed_source": metadata.get("seed_source"), "per_method": {k: v for k, v in rows.items() if k != "ALL"}, "distinct_shipment": rows.get("ALL")}
