"""Seeded synthetic data. Draws are hashes of a row number, a name and the seed, so they do not depend on partitions."""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.functions.measures import week_start
from cargolens.schemas import CITIES, DIESEL, FLOW_MODES, MODE_SHARES, MODES, ON_TIME, RATES, STATE_CODES
from cargolens.sources import readers, sinks

SEED, N_SHIPMENTS, LANES_A_GROUP, ANOMALIES = 42, 75_000, 30, 0.07
DEFAULT_SURCHARGE = 0.15


def uniform(name: str, seed: int, *keys: str | Column) -> Column:
    """In (0, 1): the first 52 bits of a hash of the text name:seed:keys, which other engines can draw as well."""
    text = F.concat_ws(":", F.lit(name), F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def normal(name: str, seed: int, *keys: str | Column) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(f"{name}a", seed, *keys))) * F.cos(2 * F.pi() * uniform(f"{name}b", seed, *keys))


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def fuel_price(week: Column) -> Column:
    """Diesel price of week 0 to 129: five straight pieces of 26 weeks, both ends included."""
    piece, step = F.floor(week / 26), week % 26
    low, high = (F.get(F.array(*[F.lit(p[i]) for p in DIESEL]), piece.cast("int")) for i in (0, 1))
    return low + (high - low) * step / 25


def fuel_surcharges(spark: SparkSession) -> DataFrame:
    weeks = spark.range(130).select(F.expr("date_add(date'2022-01-03', cast(7 * id as int))").alias("week_start"), fuel_price(F.col("id")).alias("p"))
    return weeks.select("week_start", F.round("p", 4).alias("fuel_price_per_gallon"), F.round((F.col("p") - 2.5) / 2.5 * 0.30, 4).alias("surcharge_pct"))


def flows(raw: DataFrame) -> DataFrame:
    """Origin and destination state and mode of raw flows; rows of unmapped zones are left out."""

    def state(zone: str) -> Column:
        code = F.expr(f"try_cast(substring(lpad(cast(try_cast({zone} as int) as string), greatest(3, length(cast(try_cast({zone} as int) as string))), '0'), 1, 2) as int)")
        return _lookup(STATE_CODES, code)

    mapped = raw.select(state("dms_orig").alias("orig_state"), state("dms_dest").alias("dest_state"), F.expr("try_cast(try_cast(dms_mode as double) as int)").alias("code"))
    return mapped.dropna(subset=["orig_state", "dest_state"]).withColumn("mode", _lookup(FLOW_MODES, F.col("code")))


def lane_weights(raw: DataFrame) -> DataFrame:
    return flows(raw).groupBy(F.concat_ws("-", "orig_state", "dest_state").alias("lane_id")).agg(F.count("*").alias("weight"))


def mode_shares(raw: DataFrame) -> DataFrame:
    """Share of each mode among mapped flows; an error without any, or where a mapped flow lacks its mode."""
    counts = {r["mode"]: r["n"] for r in flows(raw).withColumn("mode", F.when(F.col("code").isNull(), "?").otherwise(F.col("mode"))).groupBy("mode").agg(F.count("*").alias("n")).collect()}
    if counts.get("?"):
        raise ValueError("flows without a mode")
    total = sum(counts.get(m, 0) for m in MODES)
    if not total:
        raise ValueError("no flow has a usable mode")
    return raw.sparkSession.createDataFrame([(m, counts.get(m, 0) / total) for m in MODES], "mode string, share double")


def states() -> list[str]:
    return sorted({c.split(",")[1].strip() for c in CITIES})


def lanes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{o}-{d}",) for o in states() for d in states() if o != d], "lane_id string")


def carrier_rates(spark: SparkSession, seed: int = SEED, weights: DataFrame | None = None) -> DataFrame:
    """30 lanes of each carrier and mode without replacement, weighted by flows plus one where given."""
    pool = lanes(spark)
    pool = pool.withColumn("w", F.lit(1.0)) if weights is None else pool.join(weights, "lane_id", "left").select("lane_id", (F.coalesce("weight", F.lit(0)) + 1.0).alias("w"))
    carriers = spark.range(1, 26).select(F.format_string("CARRIER_%03d", "id").alias("carrier_id"))
    modes = spark.createDataFrame([(m, *RATES[m]) for m in MODES], "mode string, mean double, std double")
    key = ["carrier_id", "mode", "lane_id"]
    drawn = carriers.crossJoin(modes).crossJoin(pool).withColumn("draw", -F.ln(uniform("lane", seed, *key)) / F.col("w"))
    kept = drawn.withColumn("n", F.row_number().over(Window.partitionBy("carrier_id", "mode").orderBy("draw", "lane_id"))).where(F.col("n") <= LANES_A_GROUP)
    mean = F.col("mean") * (0.85 + 0.3 * uniform("carrier", seed, "carrier_id", "mode")) * (0.9 + 0.2 * uniform("factor", seed, *key))
    rate = F.greatest(F.lit(2.0), mean + F.col("std") * 0.3 * normal("rate", seed, *key))
    return kept.select(*key, F.round(rate, 4).alias("base_rate_per_cwt"), F.lit("2023-01-01").cast("date").alias("effective_date"))


def _pick(values: Column, u: Column) -> Column:
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def shipments(rates: DataFrame, fuel: DataFrame, n: int = N_SHIPMENTS, seed: int = SEED, shares: tuple[float, ...] = MODE_SHARES, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    """(shipments, truth). Each shipment takes a rate row, by mode share, so that it has a rate by construction."""
    spark = rates.sparkSession
    supported = {r["mode"]: r["n"] for r in rates.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    weight = dict(zip(MODES, shares))
    if set(supported) - set(MODES) or sum(weight[m] * c for m, c in supported.items()) <= 0:
        raise ValueError("unsupported modes in rates, or no mode has a share")
    total = sum(weight[m] * c for m, c in supported.items())
    numbered = rates.withColumn("k", F.row_number().over(Window.partitionBy("mode").orderBy("carrier_id", "lane_id")) - 1)
    edges, at = [], 0.0
    for m in MODES:
        edges.append((m, at, at + weight[m] * supported.get(m, 0) / total, supported.get(m, 0)))
        at = edges[-1][2]
    u = F.col("u")
    mode = F.when(u < edges[0][2], MODES[0]).when(u < edges[1][2], MODES[1]).otherwise([e[0] for e in edges if e[3] and e[2] > e[1]][-1])
    base = spark.range(n).withColumn("u", uniform("mode", seed, "id")).withColumn("mode", mode)
    base = base.withColumn("k", F.floor(uniform("row", seed, "id") * _lookup({e[0]: e[3] for e in edges}, F.col("mode"))).cast("int"))
    cities = {s: [c for c in CITIES if c.endswith(f",{s}")] for s in states()}
    of = F.create_map(*[x for s, cs in cities.items() for x in (F.lit(s), F.array(*[F.lit(c) for c in cs]))])
    anomaly = uniform("anomaly", seed, "id") < ANOMALIES
    rows = (
        base.join(F.broadcast(numbered), ["mode", "k"])  # at most 25 x 3 x 30 rows
        .withColumn("is_anomaly", anomaly.cast("int"))
        .withColumn("ship_date", F.date_add(F.lit("2023-01-01").cast("date"), F.floor(uniform("day", seed, "id") * 546).cast("int")))
        .withColumn("weight", F.least(F.greatest(F.exp(6.5 + 1.2 * normal("weight", seed, "id")), F.lit(1.0)), F.lit(40_000.0)))
        .withColumn("base", F.greatest(F.lit(1.0), F.col("base_rate_per_cwt") * F.col("weight") / 100))
        .withColumn("week", week_start(F.col("ship_date")))
        .join(F.broadcast(fuel.select(F.col("week_start").alias("week"), "surcharge_pct")), "week", "left")  # one row a week
        .withColumn("fuel", F.coalesce("surcharge_pct", F.lit(DEFAULT_SURCHARGE)))
        .withColumn("total", F.col("base") * (1 + F.col("fuel")) * F.when(F.col("is_anomaly") == 1, 2.5 + 2.5 * uniform("times", seed, "id")).otherwise(1.0))
        .withColumn("prompt", _lookup(ON_TIME, F.col("mode")) * F.when(F.col("is_anomaly") == 1, 0.6).otherwise(1.0))
    )
    named = rows.select(
        F.format_string("SHP%07d", "id").alias("shipment_id"), "ship_date",
        _pick(of[F.split_part("lane_id", F.lit("-"), F.lit(1))], uniform("origin", seed, "id")).alias("origin_city"),
        _pick(of[F.split_part("lane_id", F.lit("-"), F.lit(2))], uniform("dest", seed, "id")).alias("dest_city"),
        "mode", "carrier_id", F.round("weight", 1).alias("weight_lbs"), F.round("base_rate_per_cwt", 4).alias("base_rate_per_cwt"), F.round("base", 2).alias("base_cost"),
        F.round("fuel", 4).alias("fuel_surcharge_pct"), F.round("total", 2).alias("total_cost"), (uniform("prompt", seed, "id") < F.col("prompt")).cast("int").alias("on_time_flag"),
        "lane_id", F.lit(run_id).alias("run_id"), "is_anomaly",
    )
    return named.drop("is_anomaly"), named.select("shipment_id", "is_anomaly", "run_id")


def generate(spark: SparkSession, n: int = N_SHIPMENTS, seed: int = SEED, raw_path: str | None = None, use_priors: bool = False, run_id: str | None = None) -> dict:
    """All tables and the run's metadata. Without ``use_priors``, a file of flows is needed."""
    weights, shares, run_id = None, MODE_SHARES, run_id or str(uuid.uuid4())
    if use_priors:
        print("WARNING: using fixed priors, not measured flows; the data say nothing about measured flows.", file=sys.stderr)
    else:
        if raw_path is None:
            raise FileNotFoundError("no file of flows was found; name one or use the priors")
        raw = readers.flows_csv(spark, raw_path)
        weights, found = lane_weights(raw), {r["mode"]: r["share"] for r in mode_shares(raw).collect()}
        shares = tuple(found[m] for m in MODES)
    fuel, rates = fuel_surcharges(spark), carrier_rates(spark, seed, weights)
    repeated = rates.groupBy("carrier_id", "mode", "lane_id").count().where("count > 1").count()
    if repeated:
        raise RuntimeError(f"{repeated} repeated keys among rates")
    ships, truth = shipments(rates, fuel, n, seed, shares, run_id)
    bad = truth.agg(F.sum("is_anomaly")).first()[0] or 0
    metadata = {
        "run_id": run_id, "seed_source": "PRIORS" if use_priors else "FAF5", "faf5_file": raw_path, "generated_at": datetime.now().isoformat(),
        "n_shipments": n, "n_anomalies": int(bad), "anomaly_rate": round(bad / n, 4) if n else 0.0,
    }
    return {"fuel_surcharges": fuel, "carrier_rates": rates, "shipments": ships, "anomaly_ground_truth": truth, "generation_metadata": metadata}


def write(made: dict, folder: str) -> list[str]:
    """Three tables as CSV with a header line, the truth as parquet, the metadata as JSON; their paths."""
    truth, metadata = made["anomaly_ground_truth"], made["generation_metadata"]
    paths = sinks.export_csv({name: made[name] for name in ("fuel_surcharges", "carrier_rates", "shipments")}, folder)
    truth.write.mode("overwrite").parquet(f"{folder}/anomaly_ground_truth.parquet")
    sinks.write_json(truth.sparkSession, metadata, f"{folder}/generation_metadata.json")
    return [*paths, f"{folder}/anomaly_ground_truth.parquet", f"{folder}/generation_metadata.json"]


def main(arguments: list[str] | None = None) -> list[str]:
    """python -m cargolens.operators.generate --out FOLDER [--n N] [--raw FILE | --raw-folder FOLDER] [--use-priors] [--run-id ID]"""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True)
    parser.add_argument("--n", type=int, default=N_SHIPMENTS)
    parser.add_argument("--raw")
    parser.add_argument("--raw-folder")
    parser.add_argument("--use-priors", action="store_true")
    parser.add_argument("--run-id")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    raw = readers.resolve_flows(spark, given.raw_folder, given.raw) if given.raw_folder and not given.use_priors else given.raw
    return write(generate(spark, given.n, SEED, raw, given.use_priors, given.run_id), given.out)


if __name__ == "__main__":
    print("\n".join(main()))
