"""Dashboard SQL over registered views equals the DataFrame operators."""

from __future__ import annotations

import datetime as dt

from portrisk import schemas as S
from portrisk.operators import state
from portrisk.plans.views import DASHBOARD_SQL, register_views

from .conftest import rows

T = [dt.datetime(2026, 1, d, 12) for d in range(1, 6)]


def test_dashboard_sql_matches_operators(spark):
    lineup = spark.createDataFrame([
        ("a", "1", None, None, "Esperado", "TGG", "SOJA", 100.0, T[1]),
        ("b", "1", None, None, "Esperado", "TGG", "SOJA", 200.0, T[3]),
        ("c", "2", None, None, "Esperado", "TEG", "MILHO", 50.0, T[2]),
        ("d", None, None, None, "Esperado", "TES", "SOJA", 10.0, T[4])], S.FATO_LINEUP)
    weather = spark.createDataFrame([
        ("PORTO_SANTOS_CANAL", T[0], 1.0, 3.0, 70.0, False, T[3]),
        ("PORTO_SANTOS_CANAL", T[2], 6.0, 20.0, 71.0, True, T[2]),
        ("PORTO_SANTOS_CANAL", T[2], 7.0, 20.0, 71.0, True, T[3]),
        ("SERRA_ANCHIETA_IMIGRANTES", T[1], 0.0, None, None, False, T[3])], S.FATO_CLIMA)
    news = spark.createDataFrame([
        ("n1", "SANTOS", T[0], "x", "e", 0.2, "{}"),
        ("n2", "SANTOS", T[2], "y", "e", 0.7, "{}")], S.FATO_CONTINGENCIAS)
    dim = state.points_dim(spark)
    names = register_views(spark, tables={"fato_lineup": lineup, "fato_clima": weather,
                                          "fato_contingencias_nlp": news, "dim_geografia_rota": dim})
    assert "view_feature_store_ml" in names

    ships = spark.sql(DASHBOARD_SQL["ships"])
    assert rows(ships, "lineup_id", "rain_feature", "nlp_risk_score", "data_formatada") == [
        ("b", 7.0, 0.7, "04/01/2026 09:00"), ("c", 7.0, 0.7, "03/01/2026 09:00")]
    assert rows(ships, "lineup_id") == rows(state.latest_ships(spark.table("view_feature_store_ml")), "lineup_id")

    nlp = spark.sql(DASHBOARD_SQL["nlp"]).collect()
    assert [(r.texto_original, r.score_risco) for r in nlp] == [("y", 0.7)]

    m = {r.loc_id: r for r in spark.sql(DASHBOARD_SQL["map"]).collect()}
    ref = {r.loc_id: r for r in state.map_rows(dim, weather, "inserido_em").collect()}
    assert set(m) == set(ref) and len(m) == 3
    for k in m:
        assert (m[k].lat, m[k].lon, m[k].precipitacao_mm) == (ref[k].lat, ref[k].lon, ref[k].precipitacao_mm)
    assert m["AREA_FUNDEIO_SANTOS"].precipitacao_mm is None


def test_sql_functions(spark):
    register_views(spark, tables={})
    r = spark.sql("SELECT point_x('POINT(1.5 -2)') AS x, point_y('bad') AS y, "
                  "br_number('1.250,5') AS n, br_number('10D') AS z").first()
    assert (r.x, r.y, r.n, r.z) == (1.5, None, 1250.5, 0.0)
    plan = spark.sql("SELECT point_x(coordenadas) FROM VALUES ('POINT(1 2)') t(coordenadas)") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
