"""Model properties (M1-M11, S12), stream twins (R1-R5) and the cycle (B1)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.operators import ml, state
from portrisk.operators.contingency import score_contingencies
from portrisk.operators.ingest import normalize_weather
from portrisk.plans import catalog as C
from portrisk.plans.cycle import run_cycle
from portrisk.sources import files
from portrisk.streaming import streams

from .conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def model_data(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    data = ml.label_features(ml.synth_features(keys, "k")).cache()
    train, test = ml.train_test_split(data, "k")
    model = ml.fit_risk_model(train, trees=40, depth=8)
    return data, train, test, model


def test_synth_ranges_and_share(model_data):
    data, train, test, _ = model_data
    r = data.agg(*[F.min(c).alias(f"lo_{c}") for c in S.MODEL_FEATURES],
                 *[F.max(c).alias(f"hi_{c}") for c in S.MODEL_FEATURES],
                 F.avg(1 - F.col(S.MODEL_LABEL)).alias("neg")).first()
    for c in S.MODEL_FEATURES:
        lo, hi = S.SYNTH_RANGES[c]
        assert lo <= r[f"lo_{c}"] and r[f"hi_{c}"] < hi
    assert 0.015 < r.neg < 0.06          # about 3.3% negatives (Q18)
    n_test = test.count()
    assert 0.17 < n_test / data.count() < 0.23
    assert train.join(test, "k").count() == 0


def test_split_stable_under_repartition(model_data):
    data, _, test, _ = model_data
    _, test2 = ml.train_test_split(data.repartition(7), "k")
    assert rows(test, "k") == rows(test2, "k")


def test_model_learns_minority(model_data):
    _, _, test, model = model_data
    cm, rep = ml.evaluate(ml.score(model, test))
    report = {r.row_label: r for r in rep.collect()}
    assert report["accuracy"].f1_score > 0.95
    assert report["0"].support > 0


def test_sweep_and_save_load(spark, model_data, scratch):
    data, _, test, model = model_data
    base = spark.createDataFrame([tuple(S.SWEEP_BASE[c] for c in S.MODEL_FEATURES)],
                                 ", ".join(f"{c} double" for c in S.MODEL_FEATURES))
    curve = {r.value: r.mean_probability for r in ml.sweep(model, base, "wind_feature").collect()}
    assert len(curve) == 17
    assert min(curve[v] for v in (35.0, 40.0, 60.0, 80.0)) > 0.5
    path = ml.save_model(model, scratch("model"))
    again = ml.load_model(path)
    a = rows(ml.score(model, test.limit(50)), "k", "risk_probability")
    b = rows(ml.score(again, test.limit(50)), "k", "risk_probability")
    assert a == b
    imp = ml.importances(ml.forest_nodes(spark, path)).orderBy("rank").collect()
    want = dict(zip(S.MODEL_FEATURES, model.stages[-1].featureImportances.toArray().tolist()))
    assert [r["rank"] for r in imp] == [1, 2, 3, 4] and abs(sum(r.importance for r in imp) - 1) < 1e-9
    assert {r.feature: r.importance for r in imp} == pytest.approx(want, abs=1e-9)


def test_scenario_grid_and_fleet(spark, model_data):
    _, _, _, model = model_data
    ships = spark.createDataFrame([("T1", 50000.0), ("T1", 70000.0), ("T2", 20000.0)],
                                  "terminal string, quantidade_estimada double")
    g = ml.scenario_grid(model, ships, F.lit(0.3))
    assert g.count() == 2 * len(S.SCENARIO_RAIN_VALUES) * len(S.SCENARIO_WIND_VALUES) * len(S.SCENARIO_TONNAGE_VALUES)
    assert g.select("quantidade_estimada").distinct().count() == 6
    assert g.filter(F.col("tier").isNull()).count() == 0
    fleet = ships.withColumn("rain_feature", F.lit(40.0)).withColumn("wind_feature", F.lit(5.0)) \
        .withColumn("nlp_risk_score", F.lit(0.1))
    out = ml.score_fleet(model, fleet).collect()
    assert all(r.tier == "high" for r in out)


def test_scenario_query_holds_the_start_values(spark):
    g = C.QUERIES["scenario_grid"](spark, SF_SMALL)
    tonnages = sorted(r[0] for r in g.select("quantidade_estimada").distinct().collect())
    assert tonnages == [float(t) for t in range(5000, 150001, 5000)]
    start = g.filter("quantidade_estimada = 50000 and rain_feature = 10 and wind_feature = 15")
    assert start.count() == g.select("terminal").distinct().count() > 0


# --- streams: each must equal its batch twin ---------------------------------

def test_stream_weather_twin_with_restart(spark, scratch):
    landing = scratch("land")
    w = C.SI.weather_raw(spark, SF_SMALL).select(
        F.col("loc_id").cast("string").alias("loc_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "precip", "windspeed", "humidity")
    first = w.filter(F.col("loc_id").cast("int") < 70)
    second = w.filter(F.col("loc_id").cast("int") >= 70)
    files.write_weather_csv(first, landing)
    out, ckpt = scratch("out"), scratch("ckpt")
    streams.weather_stream(spark, landing, out, ckpt).awaitTermination()
    n1 = spark.read.parquet(out).count()
    files.write_weather_csv(second, landing)      # new files land; the stream restarts from its checkpoint
    streams.weather_stream(spark, landing, out, ckpt).awaitTermination()
    got = spark.read.parquet(out)
    batch = normalize_weather(files.read_weather_csv(spark, landing))
    assert n1 == first.count() and got.count() == w.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_latest_with_corrections(spark, scratch):
    t = dt.datetime(2026, 1, 1)
    a = spark.createDataFrame([("L1", t, 1.0, 1), ("L2", t, 2.0, 2)],
                              "loc_id string, ts timestamp, v double, id long")
    b = spark.createDataFrame([("L1", t, 5.0, 3), ("L1", t - dt.timedelta(days=1), 9.0, 4)],
                              "loc_id string, ts timestamp, v double, id long")
    landing = scratch("l")
    a.write.parquet(landing + "/a")
    b.write.parquet(landing + "/b")
    src = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(landing + "/*")
    out, ckpt = scratch("o"), scratch("c")
    streams.latest_stream(src, ["loc_id"], ["ts", "id"], out, ckpt).awaitTermination()
    got = streams.read_latest(spark, out)
    assert rows(got, "loc_id", "v") == [("L1", 5.0), ("L2", 2.0)]
    assert rows(got, "loc_id", "v") == rows(state.latest_per_key(a.unionByName(b), "loc_id", "ts", "id"), "loc_id", "v")


def test_stream_dedup_exact_repeats(spark, scratch):
    t = dt.datetime(2026, 1, 1)
    day = dt.timedelta(days=1)
    rows_ = [("L1", t, 1.0), ("L1", t + day, 2.0), ("L2", t, 3.0)]
    df = spark.createDataFrame(rows_, "loc_id string, timestamp_leitura timestamp, v double")
    landing = scratch("l")
    df.write.parquet(landing + "/run1")
    df.write.parquet(landing + "/run2")        # the next hourly run re-fetches the same days
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landing + "/*")
    out, ckpt = scratch("o"), scratch("c")
    streams.dedup_stream(src, ["loc_id", "timestamp_leitura"], "timestamp_leitura", out, ckpt) \
        .awaitTermination()
    assert rows(streams.read_deduplicated(spark, out)) == sorted(rows_)


def test_stream_contingency_twin(spark, scratch):
    pages = C.contingency_pages(spark, SF_SMALL)
    landing = C._land_pages(spark, pages, scratch("news"))
    out, ckpt = scratch("o"), scratch("c")
    run = dt.datetime(2026, 1, 1)
    streams.contingency_stream(spark, landing, out, ckpt, lambda e: run, C.STANDIN_RULES).awaitTermination()
    got = streams.read_contingencies(spark, out)
    batch = score_contingencies(spark.read.parquet(landing), run, C.STANDIN_RULES)
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


# --- cycle -------------------------------------------------------------------

def test_cycle_reports_and_stops(spark, scratch):
    landing = scratch("cyc")
    C.lineup_pages(spark, SF_SMALL).write.parquet(landing + "/lineup")
    C.contingency_pages(spark, SF_SMALL).select("page_id", "batch_id", "kind", "html") \
        .write.parquet(landing + "/news")
    out = {r.step: (r.rows, r.outcome) for r in
           run_cycle(spark, landing, scratch("wh"), dt.datetime(2026, 1, 1), C.STANDIN_RULES).collect()}
    assert out["weather"][1].startswith("error")          # no weather landed: reported, cycle goes on
    assert out["lineup"] == (C.SI.table(spark, SF_SMALL, "orders").count(), "ok"), out
    assert out["contingencies"][1] == "ok"
    bad = scratch("bad")
    spark.createDataFrame([(1, "1", "lineup", "<table><tr><th>Navio Ship</th></tr><tr><td>A</td></tr></table>")],
                          S.PAGES).write.parquet(bad + "/lineup")
    out2 = {r.step: r.outcome for r in run_cycle(spark, bad, scratch("wh"), dt.datetime(2026, 1, 1)).collect()}
    assert out2["lineup"].startswith("error") and out2["contingencies"].startswith("not run")


def test_stream_lineup_twin_with_restart(spark, scratch):
    pages = C.lineup_pages(spark, SF_SMALL).cache()
    landing = scratch("lp")
    first = pages.filter(F.col("page_id") % 2 == 0)
    second = pages.filter(F.col("page_id") % 2 == 1)
    first.write.parquet(landing + "/run1")
    out, ckpt = scratch("o"), scratch("c")
    run = dt.datetime(2026, 1, 1)
    streams.lineup_stream(spark, landing + "/*", out, ckpt, run).awaitTermination()
    n1 = spark.read.parquet(out).count()
    second.write.parquet(landing + "/run2")       # the next landing; the stream resumes
    streams.lineup_stream(spark, landing + "/*", out, ckpt, run).awaitTermination()
    got = spark.read.parquet(out)
    from portrisk.operators.ingest import lineup_from_pages
    batch = lineup_from_pages(pages, run)
    assert n1 == lineup_from_pages(first, run).count() and got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_contingency_pages_that_arrive_apart(spark, scratch):
    run, landing, out, ckpt = dt.datetime(2026, 1, 1), scratch("l"), scratch("o"), scratch("c")
    for page in ((1, "b", "road", "<p>interdi&ccedil;&atilde;o total"),
                 (2, "b", "news", "<a class='feed-post-link'>paralisa&ccedil;&atilde;o</a>"), (3, "c", "road", "ok")):
        spark.createDataFrame([page], S.PAGES).write.mode("append").parquet(landing)
        streams.contingency_stream(spark, landing, out, ckpt, lambda e: run).awaitTermination()
    assert rows(streams.read_contingencies(spark, out), "batch_id", "score_risco") == [("b", 1.0), ("c", 0.0)]


def test_duplicate_line_up_header_stops_the_cycle(spark, scratch):
    bad = scratch("bad")
    page = "<table><tr><th>Terminal A<th>Terminal B<th>Cheg/Arrival d/m/y<tr><td>x<td>y<td>01/01/2026</table>"
    spark.createDataFrame([(1, "1", "lineup", page)], S.PAGES).write.parquet(bad + "/lineup")
    out = {r.step: r.outcome for r in run_cycle(spark, bad, scratch("wh"), dt.datetime(2026, 1, 1)).collect()}
    assert "duplicate column targets" in out["lineup"] and out["contingencies"].startswith("not run")


def test_stratified_split(spark, model_data):
    data = model_data[0]
    train, test = ml.train_test_split(data, "k", stratify=S.MODEL_LABEL)
    n = {r[S.MODEL_LABEL]: r["count"] for r in data.groupBy(S.MODEL_LABEL).count().collect()}
    t = {r[S.MODEL_LABEL]: r["count"] for r in test.groupBy(S.MODEL_LABEL).count().collect()}
    assert all(abs(t[c] - 0.2 * n[c]) <= 1 for c in n) and train.count() + test.count() == data.count()


def test_stream_dedup_late_files(spark, scratch):
    t0 = dt.datetime(2026, 1, 1)
    day = dt.timedelta(days=1)
    schema = "loc_id string, timestamp_leitura timestamp, v double"
    run1 = spark.createDataFrame([("L1", t0, 1.0), ("L1", t0 + 29 * day, 2.0)], schema)
    # next run: repeats of days 1 and 30 (dropped), a new reading of day 20 and the first one
    # of a new location, over a year old (both kept)
    run2 = spark.createDataFrame([("L1", t0, 1.0), ("L1", t0 + 29 * day, 2.0),
                                  ("L1", t0 + 19 * day, 3.0), ("L9", t0 - 400 * day, 0.5)], schema)
    landing = scratch("l")
    run1.write.parquet(landing + "/run1")
    run2.write.parquet(landing + "/run2")
    src = spark.readStream.schema(run1.schema).option("maxFilesPerTrigger", 1).parquet(landing + "/*")
    out, ckpt = scratch("o"), scratch("c")
    streams.dedup_stream(src, ["loc_id", "timestamp_leitura"], "timestamp_leitura", out, ckpt) \
        .awaitTermination()
    assert rows(streams.read_deduplicated(spark, out), "v") == [(0.5,), (1.0,), (2.0,), (3.0,)]


def test_landed_files_do_not_follow_the_shuffle_partitions(spark, scratch):
    from portrisk.plans import catalog as C
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        events = C._land_events(spark, "/root/testdata/sf0.001", repeats=True)
        pages = C._land_pages(spark, C.contingency_pages(spark, "/root/testdata/sf0.001"), scratch("landed-pages"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(spark.read.parquet(events).inputFiles()) <= 2 * C.LANDED_FILES
    assert len(spark.read.parquet(pages).inputFiles()) <= C.LANDED_FILES
    assert spark.read.parquet(pages).count() == C.contingency_pages(spark, "/root/testdata/sf0.001").count()
