"""Traps of the data model that the star-schema tables do not exercise, by hand-sized fixtures."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cargolens.functions.measures import percentiles
from cargolens.operators import adhoc, datasets, detect, evaluate, generate, quality, views
from cargolens.schemas import FUEL_SURCHARGES, SHIPMENTS
from cargolens.sources import readers, sinks
from cargolens.streaming import zscore_flags_stream

COLUMNS = "shipment_id string, ship_date date, origin_city string, dest_city string, mode string, carrier_id string, weight_lbs double, base_rate_per_cwt double, base_cost double, fuel_surcharge_pct double, total_cost double, on_time_flag int, lane_id string, run_id string"


def ship(i, cost, day=date(2023, 1, 2), weight=1.0, lane="A-B", mode="LTL", carrier="C1", on_time=1, city="X,AA"):
    return (f"S{i}", day, city, "Y,BB", mode, carrier, weight, 1.0, 1.0, 0.1, float(cost), on_time, lane, "r")


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, COLUMNS)


def test_groups_of_ten_count_and_nine_do_not(make):
    rows = [ship(i, 10) for i in range(9)] + [ship(9, 1000)]
    assert [r.shipment_id for r in detect.iqr_flags(make(rows)).collect()] == ["S9"]
    assert detect.iqr_flags(make(rows[1:])).count() == 0
    assert detect.zscore_flags(make(rows)).first().z_score == pytest.approx(2.846, abs=1e-3)


def test_zero_weight_is_no_flag_in_the_warehouse_variant_but_in_the_local_one(make):
    df = make([ship(i, 10) for i in range(12)] + [ship(12, 10, weight=0.0)])
    assert detect.anomaly_flags(df).count() == 0
    assert [r.shipment_id for r in evaluate.local_iqr_flags(df).collect()] == ["S12"]


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 5001), ("d", 9000)) for v in (rng.normal(size=n) if k != "d" else rng.integers(0, 5, n))] + [("e", None)]
    for small in (0, 100_000):  # by sketch and bracket, and as they are
        got = {r.k: (r.q1, r.m) for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "m": 0.5}, 1000, small).collect()}
        for k in "abcd":
            assert got[k] == pytest.approx(tuple(np.quantile([v for g, v in rows if g == k], [0.25, 0.5])))
        assert got["e"] == (None, None)


def test_lane_without_flags_has_no_score_and_goes_last(make, spark):
    df = make([ship(i, 10) for i in range(50)] + [ship(50 + i, 10 if i else 5000, lane="C-D") for i in range(50)])
    flags = spark.createDataFrame([("S50", "IQR"), ("S50", "ZSCORE")], "shipment_id string, flag_type string")
    first, last = views.lane_risk(df, flags).collect()
    assert (first.lane_id, first.anomaly_count, first.risk_score) == ("C-D", 1, pytest.approx(0.4 / 50 + 0.3, abs=1e-4))  # the overrun is capped
    assert (last.lane_id, last.avg_anomalous_cost, last.cost_overrun_pct, last.risk_score) == ("A-B", None, None, None)


def test_scorecard_counts_rows_of_both_flags_twice_and_export_once(make, spark):
    df = make([ship(0, 10), ship(1, 20)])
    flags = spark.createDataFrame([("S0", "IQR"), ("S0", "ZSCORE")], "shipment_id string, flag_type string")
    row = views.carrier_scorecard(df, flags).first()
    assert (row.total_shipments, row.total_spend) == (3, 40.0)
    truth = spark.createDataFrame([("S0", 1), ("S1", 0)], "shipment_id string, is_anomaly int")
    assert views.carrier_scorecard_export(views.labelled(df, truth)).first().total_shipments == 2
    assert views.executive_summary(df.limit(0), flags.limit(0)).first().total_shipments == 0


def test_trends_count_observed_weeks_from_monday(make):
    days = [date(2023, 1, 1) + timedelta(weeks=w) for w in (0, 1, 2, 9, 10)]  # Sundays, with a gap
    rows = [ship(f"{w}-{i}", 10 if w < 4 else 13, day=d) for w, d in enumerate(days) for i in range(5)]
    got = detect.lane_week_trends(make([*rows, ship("x", 1, day=date(2023, 6, 1))])).orderBy("week_start").collect()
    assert got[0].week_start == date(2022, 12, 26) and got[0].rolling_4wk_avg is None and len(got) == 5
    assert [r.is_anomalous for r in got] == [0, 0, 0, 0, 1]
    local = datasets.lane_week_trends(make(rows)).orderBy("week_start").collect()
    assert [r.rolling_4wk for r in local] == [None] * 4 + [10.0] and local[4].prior_weeks == 4


def test_adaptive_grouping_falls_back(make):
    lanes = [ship(i, 10 + i, lane=f"L{i}") for i in range(12)]
    assert evaluate.choose_grouping(make(lanes)) == ["carrier_id"]
    assert evaluate.choose_grouping(make(lanes[:4])) == []
    assert evaluate.choose_grouping(make([ship(i, 10) for i in range(6)])) == ["lane_id", "mode"]
    assert evaluate.local_zscore_flags(make(lanes[:4])).count() == 0


def test_metrics_of_the_small_truth(spark):
    truth = spark.createDataFrame([("S1", 1), ("S2", 0), ("S3", 1)], "shipment_id string, is_anomaly int")
    flags = spark.createDataFrame([("ZSCORE", "S1"), ("IQR", "S3")], "flag_type string, shipment_id string")
    got = {r.method: r for r in evaluate.metrics_from_export(flags, truth).collect()}
    assert (got["ZSCORE"].precision, got["ZSCORE"].recall, got["ZSCORE"].f1, got["ZSCORE"].fpr) == (1.0, 0.5, 0.6667, 0.0)
    assert (got["ALL"].tp, got["ALL"].f1) == (2, 1.0)
    unknown = spark.createDataFrame([("S9",)], "shipment_id string")
    assert evaluate.metrics(unknown, truth, "X").first().fp == 1


def test_fuel_weeks_without_shipments_stay(make, spark):
    fuel = spark.createDataFrame([(date(2023, 1, 2), 4.0, 0.1), (date(2023, 1, 9), 4.0, 0.1)], FUEL_SURCHARGES)
    assert [(r.shipments, r.avg_cost) for r in adhoc.fuel_vs_cost(fuel, make([ship(0, 10)])).collect()] == [(1, 10.0), (0, None)]


def test_bulk_load_rejects_bad_rows(spark, tmp_path):
    good = 'S1,2023-01-01,"Chicago,IL","Miami,FL",LTL,C1,1.0,2.0,3.0,0.1,4.0,1,IL-FL,null\n'
    (tmp_path / "s.csv").write_text("h\n" + good + good.replace("4.0", "x") + good.replace("S1", "NULL") + "S2,2023-01-01\n")
    rows, rejected = readers.bulk_load(spark, str(tmp_path / "s.csv"), SHIPMENTS)
    assert [(r.origin_city, r.run_id) for r in rows.collect()] == [("Chicago,IL", None)] and rejected.count() == 3


def test_files_and_exports(spark, tmp_path, make):
    assert readers.resolve_flows(spark, str(tmp_path)) is None and readers.json_object(spark, str(tmp_path / "no.json"), True) is None
    (tmp_path / "faf5_1.csv").write_text("dms_orig,dms_dest,dms_mode,tons\n171,61,1,5\n999,61,2,5\n41,61,9,5\n")
    raw = readers.flows_csv(spark, readers.resolve_flows(spark, str(tmp_path)))
    assert {r.lane_id: r.weight for r in generate.lane_weights(raw).collect()} == {"IL-CA": 1, "AZ-CA": 1}
    assert generate.mode_shares(raw).where("mode = 'PARCEL'").first().share == 1.0
    sinks.export_csv({"v": make([ship(0, 1)]).select("ship_date")}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "v.csv")).first().ship_date == "2023-01-02"
    assert sinks.run_statements(spark, "select 1; ;select 2;") == 2
    assert sinks.generation_run(spark, {"run_id": "a", "generated_at": "2024-01-01T00:00:00", "seed_source": "TEST", "n_shipments": 1}).first().faf5_file is None


def test_generator_invariants(spark):
    made = generate.generate(spark, 4000, use_priors=True, run_id="r")
    ships, rates = made["shipments"], made["carrier_rates"]
    assert rates.count() == 2250 and quality.duplicate_keys(rates, ["carrier_id", "mode", "lane_id"]).first().duplicates == 0
    assert quality.join_coverage(ships, rates).first().missing_keys == 0
    assert quality.base_cost_error(ships).first().max_error <= 0.51  # weights are rounded to 0.1 pound
    assert 0.04 <= made["generation_metadata"]["anomaly_rate"] <= 0.10 and made["fuel_surcharges"].count() == 130
    share = {r["mode"]: r["count"] / 4000 for r in ships.groupBy("mode").count().collect()}
    assert share["PARCEL"] == pytest.approx(0.4, abs=0.03)
    assert ships.where(~F.col("lane_id").rlike("^[A-Z]{2}-[A-Z]{2}$") | F.col("origin_city").isNull() | (F.col("total_cost") <= 0)).count() == 0
    with pytest.raises(FileNotFoundError):
        generate.generate(spark, 10)


def test_registered_generator_makes_the_default_number(spark):
    from cargolens.plans import registry

    assert registry.queries()["gen_shipments"](spark, "").count() == generate.N_SHIPMENTS == 75_000


def test_checks(make):
    counted = quality.row_counts({"SHIPMENTS": make([ship(0, 1)]), "X": make([]), "Y": make([ship(0, 1)])}, {"SHIPMENTS": 2})
    assert [(r.table_name, r.expected, r.status) for r in counted.collect()] == [("SHIPMENTS", 2, "WARN"), ("X", 1, "WARN"), ("Y", 1, "OK")]
    df = make([ship(0, 1), (None, *ship(1, 1)[1:])])
    assert {r.column_name: r.status for r in quality.null_counts(df).collect()}["shipment_id"] == "WARN"


def test_marks_are_the_flags(make):
    rows = [ship(i, 10 + i % 7, lane=f"L{i % 3}", weight=0.0 if i % 50 == 0 else 1.0) for i in range(300)] + [ship(300 + i, 500 + 90 * i, lane=f"L{i % 2}") for i in range(5)] + [ship(400, 9, lane="few")]
    df = make(rows)
    flags, marked = detect.anomaly_flags(df), detect.marked(df)
    for kind, column in (("ZSCORE", "z_flag"), ("IQR", "iqr_flag")):
        ids = sorted(r.shipment_id for r in flags.where(F.col("flag_type") == kind).collect())
        assert ids and sorted(r.shipment_id for r in marked.where(f"{column} = 1").collect()) == ids
    assert marked.count() == len(rows) and marked.columns == [*df.columns, "z_flag", "iqr_flag", "is_anomaly_flag"]
    same = lambda a, b: [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in sorted(a.collect(), key=str)] == [tuple(r) for r in sorted(b.collect(), key=str)]
    assert same(views.carrier_scorecard(df, flags), views.carrier_scorecard_of(marked)) and same(views.anomaly_rate_by_region(df, flags), views.anomaly_rate_of(marked))
    assert same(views.executive_summary(df, flags), views.executive_summary_of(marked)) and same(views.lane_risk(df, flags), views.lane_risk_of(marked))


def test_local_flags_against_all_shipments(make, spark):
    """No peer group has five shipments: statistics are those of all."""
    df = make([ship(i, 10 + i % 2, lane=f"L{i}", carrier=f"C{i}", mode=f"M{i}") for i in range(20)] + [ship(20, 900, lane="x", carrier="y", mode="z")])
    assert evaluate.choose_grouping(df) == [] and [r.shipment_id for r in evaluate.local_zscore_flags(df).collect()] == ["S20"]
    assert [r.shipment_id for r in evaluate.local_iqr_flags(df).collect()] == ["S20"]
    truth = spark.createDataFrame([("S20", 1), ("S1", 0)], "shipment_id string, is_anomaly int")
    text = evaluate.metrics_as_text(evaluate.eval_metrics(df, truth)).collect()
    assert [tuple(r) for r in text] == [(m, "1.000", "1.000", "1.000", "0.000", "1") for m in ("IQR", "ZSCORE", "ALL (distinct)")]
    many = spark.createDataFrame([(f"T{i}", "S20") for i in range(130)], "flag_type string, shipment_id string")
    assert evaluate.metrics_from_export(many, truth).count() == 131


def test_tables_and_generated_files(spark, tmp_path):
    made = generate.generate(spark, 50, use_priors=True, run_id="r")
    paths = generate.write(made, str(tmp_path / "out"))
    assert [p.rsplit("/")[-1] for p in paths] == ["fuel_surcharges.csv", "carrier_rates.csv", "shipments.csv", "anomaly_ground_truth.parquet", "generation_metadata.json"]
    ships = readers.shipments_csv(spark, paths[2])
    assert ships.count() == 50 == readers.truth_parquet(spark, paths[3]).count() and readers.json_object(spark, f"{paths[4]}/*.txt")["run_id"] == "r"
    sinks.create_tables(spark, "freight", str(tmp_path / "db"))
    try:
        sinks.store(ships, "shipments")
        sinks.store(ships, "shipments")
        flags = detect.anomaly_flags(make_flagged(ships))
        sinks.store(flags, "anomaly_flags")
        for _ in range(2):
            sinks.store(sinks.generation_run(spark, made["generation_metadata"]), "generation_runs", append=True)
        sinks.store(detect.lane_week_trends(ships, 1), "lane_week_trends")
        assert spark.table("shipments").count() == 50 and spark.table("generation_runs").count() == 2 and spark.table("lane_week_trends").count() > 0
        stored = spark.table("anomaly_flags")
        assert stored.count() == flags.count() > 0 and stored.where("created_at is null").count() == 0
    finally:
        spark.sql("DROP SCHEMA freight CASCADE")
        spark.sql("USE default")


def make_flagged(ships):
    return ships.withColumn("lane_id", F.lit("L")).withColumn("mode", F.lit("LTL"))


def test_stream_of_shipments(spark, tmp_path, make):
    history = make([ship(i, 10 + i % 3) for i in range(30)])
    make([ship(0, 10), ship(1, 500)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    q = zscore_flags_stream(stream, history).writeStream.format("memory").queryName("flags_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.shipment_id for r in spark.table("flags_stream").collect()] == ["S1"]
