"""Reports (A1-A11) against pandas/NumPy, and file sources/sinks."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.operators import reports
from portrisk.sources import files

from .conftest import rows


@pytest.fixture(scope="module")
def values(spark):
    rnd = np.random.default_rng(3)
    v = np.round(rnd.gamma(1.5, 8.0, 2000), 2)
    v[::97] = np.nan
    pdf = pd.DataFrame({"a": v, "b": np.round(rnd.uniform(0, 60, 2000), 1), "c": rnd.integers(0, 5, 2000)})
    return pdf, spark.createDataFrame(pdf)


def test_describe_matches_pandas(values):
    pdf, df = values
    out = {(r.measure, r.stat): r.value for r in reports.describe_columns(df, ["a", "b", "c"]).collect()}
    desc = pdf[["a", "b", "c"]].describe()
    for col in ("a", "b", "c"):
        for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
            assert out[(col, stat)] == pytest.approx(float(desc.loc[stat, col]), rel=1e-9, abs=1e-9)


def test_exact_quantiles_many_partitions(spark, values):
    pdf, df = values
    for parts in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        q = {r.prob: r.value for r in reports.exact_quantiles(df, "a", [0.1, 0.5, 0.99]).collect()}
        for p in (0.1, 0.5, 0.99):
            assert q[p] == pytest.approx(float(pdf["a"].quantile(p)), rel=1e-12)


def test_histogram_covers_all_rows(values):
    pdf, df = values
    h = reports.histogram(df, "a", bins=20).orderBy("bin").collect()
    counts, _ = np.histogram(pdf["a"].dropna(), bins=20)
    assert len(h) == 20 and sum(r["count"] for r in h) == int(pdf["a"].notna().sum())
    assert [r["count"] for r in h] == pytest.approx(list(counts), abs=2)


def test_kde_integrates_to_one(values):
    _, df = values
    k = reports.kde(df, "a", grid_size=400, cut=3.0).orderBy("i").collect()
    xs = np.array([r.x for r in k])
    ys = np.array([r.density for r in k])
    assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.01)


@pytest.mark.parametrize("n", [500, 60_000])
def test_kde_equals_the_kernel_sum_with_a_heavy_tail(spark, n):
    rnd = np.random.default_rng(8)
    v = np.round(np.append(rnd.exponential(1.0, n), [200.0, 5000.0]), 3)
    df = spark.createDataFrame(pd.DataFrame({"a": v}))
    k = reports.kde(df, "a", grid_size=60).orderBy("i").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    assert len(k) == 60 and k[0].x == v.min() and k[-1].x == pytest.approx(v.max())
    for r in k:
        exact = np.exp(-0.5 * ((r.x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(exact, rel=1e-9, abs=1e-15)


def test_kde_and_describe_of_nothing(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert reports.kde(none, "a").count() == 0 and reports.auto_bins(none, "a") == 1
    out = {r.stat: r.value for r in reports.describe_columns(none, ["a"]).collect()}
    assert out["count"] == 0.0 and out["mean"] is None and len(out) == 8


def test_automatic_bins(values):
    pdf, df = values
    v = pdf["a"].dropna()
    width = min(2 * (v.quantile(0.75) - v.quantile(0.25)) / len(v) ** (1 / 3), (v.max() - v.min()) / (np.log2(len(v)) + 1))
    assert reports.histogram(df, "a").count() == math.ceil((v.max() - v.min()) / width)


def test_value_counts_and_share(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,)], "t string")
    top = reports.value_counts(df, "t", 2).collect()
    assert [(r.t, r["count"], r["rank"]) for r in top] == [("b", 2, 1), ("c", 2, 2)]
    share = {r.t: r.share for r in reports.class_share(df, "t").collect()}
    assert share == {"a": 0.2, "b": 0.4, "c": 0.4}


def test_kpis_and_access_risk(spark):
    ships = spark.createDataFrame([(1.0, 0.2, "T1", 100.0), (None, 0.4, "T1", 50.0), (3.0, 0.0, "T2", 10.0)],
                                  "rain_feature double, nlp_risk_score double, terminal string, "
                                  "quantidade_estimada double").withColumn("inserido_em", F.current_timestamp())
    k = reports.fleet_kpis(ships).first()
    assert (k.n_ships, k.mean_rain_mm) == (3, 2.0) and k.mean_nlp_risk_pct == pytest.approx(20.0)
    v = {r.terminal: (r.total_volume, r.n_ships) for r in reports.volume_by_terminal(ships).collect()}
    assert v == {"T1": (150.0, 2), "T2": (10.0, 1)}
    news = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 0.2, "x"), ("b", dt.datetime(2026, 1, 2), 0.5, "y")],
                                 "cont_id string, timestamp_leitura timestamp, score_risco double, texto_original string")
    r = reports.access_risk(news).first()
    assert (r.access_risk_pct, r.tier, r.texto_original) == (50.0, "alert", "y")
    empty = reports.access_risk(news.filter("false")).first()
    assert (empty.access_risk_pct, empty.tier) == (0.0, "normal")


def test_confusion_and_report_match_sklearn_rules(spark):
    y = [0, 0, 1, 1, 1, 1, 0, 1]
    p = [0, 1, 1, 1, 0, 1, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    cm = {(r.label, r.prediction): r["count"] for r in reports.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 4}
    rep = {r.row_label: r for r in reports.classification_report(df).collect()}
    assert rep["1"].precision == pytest.approx(0.8) and rep["1"].recall == pytest.approx(0.8)
    assert rep["0"].f1_score == pytest.approx(2 / 3)
    assert rep["accuracy"].f1_score == pytest.approx(0.75) and rep["accuracy"].support == 8
    assert rep["macro avg"].precision == pytest.approx((2 / 3 + 0.8) / 2)
    assert rep["weighted avg"].recall == pytest.approx(0.75)
    none = spark.createDataFrame([(1, 1)], "label int, prediction int")
    assert {r.row_label: r.precision for r in reports.classification_report(none).collect()}["0"] == 0.0


# --- sources and sinks -------------------------------------------------------

def local(uri: str) -> str:
    return uri[len("file:"):] if uri.startswith("file:") else uri


def test_weather_csv_locations(spark, scratch):
    path = local(scratch("csv"))
    for loc, body in (("PORTO_SANTOS_CANAL", "datetime,precip,windspeed,humidity\n2026-01-01,1.5,3,80\n2026-01-02,,16,\n"),
                      ("AREA_FUNDEIO_SANTOS", "datetime,precip,windspeed,humidity\n2026-01-01,6,1,60\nbroken,line\n")):
        os.makedirs(f"{path}/loc_id={loc}", exist_ok=True)
        with open(f"{path}/loc_id={loc}/part.csv", "w") as f:
            f.write(body)
    df = files.read_weather_csv(spark, path, quarantine=True).cache()
    assert df.count() == 4
    assert df.filter(F.col("_corrupt_record").isNotNull()).count() == 1
    assert rows(df.groupBy("loc_id").count()) == [("AREA_FUNDEIO_SANTOS", 2), ("PORTO_SANTOS_CANAL", 2)]


def test_weather_csv_by_header_name_and_list_of_paths(spark, scratch):
    paths = [local(scratch("csv")) for _ in range(2)]
    for path, loc, body in (
            (paths[0], "A%20B", 'name,datetime,tempmax,humidity,precip,windspeed\n"x, y",2026-01-01,30,80,7.5,20\n'),
            (paths[1], "C", '\ufeffWindspeed,conditions,precip,datetime,humidity\r\n3,"a ""b"" c",,2026-01-02,\r\n'),
            (paths[1], "D", "datetime,windspeed,humidity\n2026-01-01,1,2\n"), (paths[1], "E", "\n")):
        os.makedirs(f"{path}/loc_id={loc}", exist_ok=True)
        with open(f"{path}/loc_id={loc}/part.csv", "w", newline="") as f:
            f.write(body)
    got = rows(files.read_weather_csv(spark, paths), "loc_id", "datetime", "precip", "windspeed", "humidity")
    assert got == [("A B", "2026-01-01", 7.5, 20.0, 80.0), ("C", "2026-01-02", None, 3.0, None)]
    rejects = files.weather_rejects(files.weather_files(spark.read, paths))
    assert rows(rejects, "loc_id", "reason") == [
        ("D", "missing columns: precip"), ("E", "missing columns: datetime, precip, windspeed, humidity")]


def test_append_twice_doubles(spark, scratch):
    path = scratch("append")
    df = spark.createDataFrame([("L", dt.datetime(2026, 1, 1), 1.0, None, None, False, None)], S.FATO_CLIMA)
    assert files.append_table(df, path, S.FATO_CLIMA) == 1
    assert files.append_table(df, path, S.FATO_CLIMA) == 1
    assert files.read_table(spark, path, S.FATO_CLIMA).count() == 2


def test_ndjson_failfast_and_permissive(spark, scratch):
    path = local(scratch("nd"))
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/a.json", "w") as f:
        f.write('{"lineup_id":"1","quantidade_estimada":10.5,"inserido_em":"2026-01-01 00:00:00"}\n')
        f.write('{"lineup_id":"2","quantidade_estimada":"lots","inserido_em":"2026-01-01 00:00:00"}\n')
    with pytest.raises(Exception):
        files.read_ndjson(spark, path, S.FATO_LINEUP, mode="FAILFAST").collect()
    assert files.read_ndjson(spark, path, S.FATO_LINEUP, mode="PERMISSIVE").count() == 2


def test_ndjson_roundtrip_text_formats(spark, scratch):
    path = scratch("nd2")
    df = spark.createDataFrame([("1", dt.date(2026, 1, 3), dt.datetime(2026, 1, 3, 10, 30))],
                               "lineup_id string, data_chegada_prevista date, data_atracacao_prevista timestamp")
    assert files.append_ndjson(df, path) == 1
    text = spark.read.text(path).first()[0]
    assert '"2026-01-03"' in text and '"2026-01-03 10:30:00"' in text


def test_required_columns_are_checked(spark, scratch):
    df = spark.createDataFrame([("L", None, 1.0, None, None, None, None)], ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in S.FATO_CLIMA.fields))
    with pytest.raises(Exception, match="NULL in required column alerta_critico"):
        files.append_table(df, scratch("t"), S.FATO_CLIMA)


def test_tables_keep_partitions(spark, scratch):
    db = "portrisk_ddl_db"
    files.create_tables(spark, db, scratch("wh"), partition_by={"fato_lineup": ["status_atual"]})
    ddl = spark.sql(f"SHOW CREATE TABLE {db}.fato_lineup").first()[0]
    assert "PARTITIONED BY (status_atual)" in ddl
    files.drop_tables(spark, list(S.TABLE_SCHEMAS), db)


def test_create_and_drop_tables(spark, scratch):
    db = "portrisk_test_db"
    created = {r.name: r.outcome for r in files.create_tables(spark, db, scratch("wh")).collect()}
    assert created["fato_clima"] == "created"
    assert {r.outcome for r in files.create_tables(spark, db, scratch("wh")).collect()} == {"exists"}
    first = {r.name: r.outcome for r in files.drop_tables(spark, ["fato_clima", "nope"], db).collect()}
    assert first == {"fato_clima": "dropped", "nope": "absent"}
    again = {r.name: r.outcome for r in files.drop_tables(spark, ["fato_clima"], db).collect()}
    assert again == {"fato_clima": "absent"}


def test_load_report(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "loc_id string")
    assert rows(files.load_report(df)) == [("a", 2), ("b", 1)]


def test_a_cell_of_a_table_takes_few_calls():
    import sys
    from portrisk.functions.text import read_table
    page = "<table><tr><th>a<th>b</tr>" + "<tr><td>1<td>x y" * 200 + "</table>"
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")
    sys.setprofile(count)
    try:
        header, rows = read_table(page)
    finally:
        sys.setprofile(None)
    assert header == ["a", "b"] and rows == [["1", "x y"]] * 200
    assert calls / 400 < 60


def test_bare_tags_end_what_tags_with_attributes_end_and_raw_text_stays_raw():
    from portrisk.functions.text import read_table, read_text
    rows = "<tr><td>1<td>a<b>b</b><tr><td>2<td><table><tr><td>in</table></table>"
    assert read_table("<table>" + rows) == read_table("<table x=1>" + rows.replace("<td>", "<td k>").replace("<tr>", "<TR>"))
    assert read_text("<title>a &amp; b</title><p>c<script>if (a<b) <td></script>d<style><p></style>e") == "a & bcde"


def test_plain_cells_are_read_as_their_tags_one_by_one(monkeypatch):
    import random
    import re
    from portrisk.functions import text
    calls, start = [], text._Tables.handle_starttag
    monkeypatch.setattr(text._Tables, "handle_starttag", lambda self, tag, attrs: calls.append(tag) or start(self, tag, attrs))
    body = "".join(f"<tr><td>a {i}<td>  b  {i} </td> <td>c</td>" for i in range(50))
    assert text.read_table(f"<table>{body}</table>") == (["0", "1", "2"], [[f"a {i}", f"b {i}", "c"] for i in range(50)])
    assert len(calls) <= 1 + 50 * 3  # not a call a cell
    rng = random.Random(3)
    parts = ["<tr>", "<td>", "<td>", "</td>", "</tr>", "<th>", "x", " y  z", "\n", "&amp;", "<b>", "</b>", "<table>", "</table>", "<td rowspan=2>",
             "<td colspan=2>", "<thead>", "</thead>", "<template>", "</template>", "<script>", "</script>", "<!-- <td> -->", "<TD>", "<"]
    pages = ["<table><tr>" + "".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(5000)]
    fast = [(text.read_table(p), text.read_table(p, 1)) for p in pages]
    monkeypatch.setattr(text, "_PLAIN", re.compile("(?!)"))
    assert fast == [(text.read_table(p), text.read_table(p, 1)) for p in pages]
