"""Weather and line-up cleaning (P1, P4-P10, X2, U1, E5) on FIXTURES.md 1.1/1.2."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.operators import ingest
from portrisk.sources import html

from .conftest import rows

NAN = float("nan")
RUN = dt.datetime(2026, 1, 10, 12, 0, 0)

WEATHER = [
    ("PORTO_SANTOS_CANAL", "2026-01-01", 0.0, 10.0, 80.0),
    ("PORTO_SANTOS_CANAL", "2026-01-02", 5.0, 15.0, 81.0),
    ("PORTO_SANTOS_CANAL", "2026-01-03", 5.1, 2.0, 82.0),
    ("SERRA_ANCHIETA_IMIGRANTES", "2026-01-01", None, 16.0, 70.0),
    ("SERRA_ANCHIETA_IMIGRANTES", "2026-01-02", None, None, None),
    ("AREA_FUNDEIO_SANTOS", "2026-01-01", NAN, 1.0, 60.0),
    ("AREA_FUNDEIO_SANTOS", "2026-01-02", 6.0, None, 60.0),
    ("AREA_FUNDEIO_SANTOS", "2026-01-02", 6.0, None, 60.0),
]


def test_normalize_weather_fixture(spark):
    raw = spark.createDataFrame(WEATHER, "loc_id string, datetime string, precip double, "
                                         "windspeed double, humidity double")
    out = ingest.normalize_weather(raw)
    assert out.schema["alerta_critico"].dataType.simpleString() == "boolean"
    got = [(r.loc_id, r.timestamp_leitura.day, r.precipitacao_mm, r.alerta_critico)
           for r in out.collect()]
    assert got == [
        ("PORTO_SANTOS_CANAL", 1, 0.0, False), ("PORTO_SANTOS_CANAL", 2, 5.0, False),
        ("PORTO_SANTOS_CANAL", 3, 5.1, True), ("SERRA_ANCHIETA_IMIGRANTES", 1, 0.0, True),
        ("SERRA_ANCHIETA_IMIGRANTES", 2, 0.0, False), ("AREA_FUNDEIO_SANTOS", 1, 0.0, False),
        ("AREA_FUNDEIO_SANTOS", 2, 6.0, True), ("AREA_FUNDEIO_SANTOS", 2, 6.0, True)]
    assert out.filter(F.col("alerta_critico").isNull()).count() == 0


def test_dedup_keeps_last_ingested(spark):
    raw = spark.createDataFrame(WEATHER, "loc_id string, datetime string, precip double, "
                                         "windspeed double, humidity double")
    w = ingest.normalize_weather(raw)
    first = w.withColumn("inserido_em", F.lit(dt.datetime(2026, 1, 2)))
    fixed = w.filter(F.col("loc_id") == "AREA_FUNDEIO_SANTOS").withColumn(
        "precipitacao_mm", F.lit(7.0)).withColumn("inserido_em", F.lit(dt.datetime(2026, 1, 3)))
    out = ingest.dedup_readings(ingest.union_batches([first, fixed]))
    assert out.count() == 7
    assert rows(out.filter(F.col("loc_id") == "AREA_FUNDEIO_SANTOS"), "precipitacao_mm") == [(7.0,), (7.0,)]


def test_union_batches_empty():
    assert ingest.union_batches([]) is None


def test_rename_last_key_wins_and_errors(spark):
    df = spark.createDataFrame([("a", "b")], "`Terminal IMO` string, `Navio Ship` string")
    assert ingest.rename_by_substring(df).columns == ["ship_id", "nome_navio"]
    dup = spark.createDataFrame([("a", "b")], "`Terminal A` string, `Terminal B` string")
    with pytest.raises(ingest.ColumnMappingError):
        ingest.rename_by_substring(dup)
    with pytest.raises(ingest.ColumnMappingError, match="detected columns"):
        ingest.require_columns(ingest.rename_by_substring(df), ["data_chegada_prevista"])


LINEUP = [
    ("A", "9000001", "03/01/2026 10:30", "SOJA", "52.500,75", "TGG"),
    ("B", "9000002", "31/12/2025", "MILHO", "1.250.000", "TEG"),
    ("C", "9000003", "13/13/2026", "ACUCAR", "abc", "TGG"),
    ("D", None, "05/01/2026", "SOJA", "nan", "TES"),
    ("A", "9000001", "03/01/2026 10:30", "FARELO", "1.000", "TGG"),
]
LINEUP_SCHEMA = ("`Navio Ship` string, IMO string, `Cheg/Arrival d/m/y` string, "
                 "`Mercadoria Goods` string, `Peso Weight` string, Terminal string")


def test_normalize_lineup_fixture(spark):
    raw = spark.createDataFrame(LINEUP, LINEUP_SCHEMA)
    out = ingest.normalize_lineup(ingest.rename_by_substring(raw), RUN)
    assert out.columns == S.LINEUP_COLUMNS
    got = [(r.ship_id, r.data_chegada_prevista, r.quantidade_estimada, r.status_atual, r.inserido_em)
           for r in out.collect()]
    assert got == [
        ("9000001", dt.date(2026, 1, 3), 52500.75, "Esperado", RUN),
        ("9000002", dt.date(2025, 12, 31), 1250000.0, "Esperado", RUN),
        ("9000003", None, 0.0, "Esperado", RUN),
        (None, dt.date(2026, 1, 5), 0.0, "Esperado", RUN),
        ("9000001", dt.date(2026, 1, 3), 1000.0, "Esperado", RUN)]
    first = out.first()
    assert first.data_atracacao_prevista == dt.datetime(2026, 1, 3, 10, 30)
    assert ingest.normalize_lineup(ingest.rename_by_substring(raw), RUN, drop_null=True).count() == 4
    assert out.select("lineup_id").distinct().count() == 5


def test_lineup_strict_projection(spark):
    raw = spark.createDataFrame([("A", "03/01/2026")], "`Navio Ship` string, `Cheg/Arrival d/m/y` string")
    named = ingest.rename_by_substring(raw)
    with pytest.raises(ingest.ColumnMappingError):
        ingest.normalize_lineup(named, RUN, strict=True)
    tolerant = ingest.normalize_lineup(named, RUN, strict=False)
    assert "ship_id" not in tolerant.columns and tolerant.count() == 1


def page(head_rows, body_rows, thead=True):
    h = "".join("<tr>" + "".join(f"<th>{c}</th>" for c in r) + "</tr>" for r in head_rows)
    b = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in body_rows)
    h = f"<thead>{h}</thead>" if thead else h
    return f"<html><body><p>x</p><table class='t'>{h}<tbody>{b}</tbody></table><table><tr><td>2nd</td></tr></table></body></html>"


def test_lineup_from_two_level_header_page(spark):
    heads = [["Navio", "IMO", "Cheg/Arrival", "Mercadoria", "Peso", "Terminal"],
             ["Ship", "", "d/m/y", "Goods", "Weight", ""]]
    body = [["A &amp; Co", "9000001", "03/01/2026 10:30", "SOJA", "52.500,75", "<b>TGG</b>"],
            ["B", "9000002", "31/12/2025", "MILHO", "1.250.000", "TEG"]]
    pages = spark.createDataFrame([(1, page(heads, body, thead=False)), (2, page(heads, body[:1]))],
                                  "page_id long, html string")
    t = html.html_tables(pages)
    assert t.first().header == ["Navio Ship", "IMO", "Cheg/Arrival d/m/y", "Mercadoria Goods",
                                "Peso Weight", "Terminal"]
    out = ingest.lineup_from_pages(pages, RUN)
    got = rows(out, "ship_id", "terminal", "quantidade_estimada", "data_chegada_prevista")
    assert got == [("9000001", "TGG", 52500.75, dt.date(2026, 1, 3)),
                   ("9000001", "TGG", 52500.75, dt.date(2026, 1, 3)),
                   ("9000002", "TEG", 1250000.0, dt.date(2025, 12, 31))]
    # re-running the same batch gives the same ids
    again = ingest.lineup_from_pages(pages, RUN)
    assert rows(out, "lineup_id") == rows(again, "lineup_id")


def test_pages_without_table_yield_no_rows(spark):
    pages = spark.createDataFrame([(1, "<html><body><p>no table</p></body></html>"), (2, None)],
                                  "page_id long, html string")
    assert html.html_tables(pages).count() == 0
    assert html.html_tables(pages, table_index=3).count() == 0


def test_lineup_page_missing_date_column_fails(spark):
    p = page([["Navio Ship", "IMO", "Terminal"]], [["A", "1", "TGG"]])
    pages = spark.createDataFrame([(1, p)], "page_id long, html string")
    with pytest.raises(Exception, match="no column for 'data_chegada_prevista'"):
        ingest.lineup_from_pages(pages, RUN).collect()


def test_lineup_page_duplicate_targets_fail(spark):
    p = page([["Terminal A", "Terminal B", "Cheg/Arrival d/m/y"]], [["x", "y", "01/01/2026"]])
    pages = spark.createDataFrame([(1, p)], "page_id long, html string")
    with pytest.raises(Exception, match="duplicate column"):
        ingest.lineup_from_pages(pages, RUN, strict=False).collect()


def test_with_row_id(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    ids = rows(ingest.with_row_id(df, "id", ["k"]), "id")
    assert len({i for (i,) in ids}) == 2
    assert ingest.with_row_id(df, "id").select("id").distinct().count() == 2


def test_colspan_header_expanded(spark):
    html_ = ("<table><tr><th>Navio</th><th>IMO</th><th colspan='2'>Chegada</th></tr>"
             "<tr><th>Ship</th><th></th><th>Arrival d/m/y</th><th>Weight</th></tr>"
             "<tr><td>A</td><td>1</td><td colspan=2>03/01/2026</td></tr></table>")
    pages = spark.createDataFrame([(1, html_)], "page_id long, html string")
    r = html.html_tables(pages).first()
    assert r.header == ["Navio Ship", "IMO", "Chegada Arrival d/m/y", "Chegada Weight"]
    assert r.cells == ["A", "1", "03/01/2026", "03/01/2026"]


@pytest.mark.parametrize("source, header, cells", [
    ("<!-- <table><tr><td>old</table> --><table><tr><th>a<th>b<tr><td>1<td>2</table>", ["a", "b"], [["1", "2"]]),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2<tr><td>y<td>3</table>", ["0", "1"], [["x", "1"], ["x", "2"], ["y", "3"]]),
    ("<table><tr><th colspan=2>N</th><th rowspan=2>R</th></tr><tr><th>k<th>n</tr><tr><td>1<td>2<td>3</table>",
     ["N k", "N n", "R R"], [["1", "2", "3"]]),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table>b<td>c</table>", ["0", "1"], [["ainnerb", "c"]]),
    ("<table><tr><td>&ccedil;&#x110000;&#38;lt;<td> a \n b </table>", ["0", "1"], [["ç\ufffd&lt;", "a b"]]),
])
def test_tables_as_a_parser_reads_them(spark, source, header, cells):
    got = html.html_tables(spark.createDataFrame([(1, source)], "page_id long, html string")).orderBy("row").collect()
    assert [r.header for r in got] == [header] * len(cells) and [r.cells for r in got] == cells


def test_a_wide_colspan_is_not_cut(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td colspan=1500>x</table>")], "page_id long, html string")
    assert html.html_tables(pages).first().cells == ["x"] * 1500


def test_elements_nest_and_class_is_an_attribute(spark):
    page_ = "<div class='ad'>a<div class=ad>b</div>c</div><div data-class='ad'>no</div><div class='x ad'>d"
    pages = spark.createDataFrame([(1, page_)], "page_id long, html string")
    assert [r.text for r in html.page_elements(pages, "div", "ad").orderBy("ord").collect()] == ["abc", "b", "d"]
