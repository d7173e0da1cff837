"""Road/news scoring with the original Portuguese rules (FIXTURES.md 1.3, 1.4)."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.functions.text import page_text
from portrisk.operators.contingency import contingency_from_json, score_contingencies
from portrisk.sources.files import split_json_rows
from portrisk.sources.html import page_elements

RUN = dt.datetime(2026, 1, 10, 12, 0)


def road(text):
    return f"<html><head><title>Ecovias</title></head><body><div id='s'>{text}</div></body></html>"


def news(*headlines):
    links = "".join(f'<a class="feed-post-link gui-color-hover" href="/n{i}">{h}</a><a href="/x">greve lateral</a>'
                    for i, h in enumerate(headlines))
    return f"<html><body><!-- greve --><div>{links}</div></body></html>"


CASES = {
    "none": ([road("tráfego normal")], 0.0, 0, S.NO_ALERT_TEXT),
    "slow": ([road("LENTIDÃO no km 40")], 0.2, 1, "Ecovias: Tráfego lento."),
    "blocked": ([road("bloqueio e lentidão")], 0.5, 1, "Ecovias: Bloqueio detectado no SAI."),
    "slow_strike": ([road("congestionamento"), ("news", news("Greve no porto"))], 0.7, 2,
                    "Ecovias: Tráfego lento. | G1: Greve no porto..."),
    "cap": ([road("interdição"), ("news", news("protesto a", "protesto b", "protesto c"))], 1.0, 4, None),
    "sixth": ([road("tráfego normal"), ("news", news("a", "b", "c", "d", "e", "greve f"))], 0.0, 0,
              S.NO_ALERT_TEXT),
    "long": ([road("tráfego normal"), ("news", news("x" * 20 + " greve " + "y" * 33))], 0.5, 1,
             "G1: " + ("x" * 20 + " greve " + "y" * 33)[:40] + "..."),
    "road_missing": ([("news", news("paralisação total"))], 0.5, 1, "G1: paralisação total..."),
    "script_only": ([road("<script>var s='bloqueio';</script>ok")], 0.0, 0, S.NO_ALERT_TEXT),
    "split_tag": ([road("<b>blo</b>queio")], 0.5, 1, "Ecovias: Bloqueio detectado no SAI."),
}


@pytest.fixture(scope="module")
def scored(spark):
    data = []
    pid = 0
    for batch, (pages, *_rest) in CASES.items():
        for p in pages:
            kind, html = p if isinstance(p, tuple) else ("road", p)
            pid += 1
            data.append((pid, batch, kind, html))
    pages = spark.createDataFrame(data, S.PAGES)
    return {r.batch_id: r for r in score_contingencies(pages, RUN).collect()}


@pytest.mark.parametrize("batch", list(CASES))
def test_case(scored, batch):
    _, score, n, text = CASES[batch]
    row = scored[batch]
    assert row.score_risco == pytest.approx(score)
    assert json.loads(row.json_extraido) == {"alertas": n}
    if text is not None:
        assert row.texto_original == text
    assert row.loc_id == S.CONTINGENCY_LOC and row.timestamp_leitura == RUN
    assert 0.0 <= row.score_risco <= 1.0


def test_cap_text_has_four_parts(scored):
    assert len(scored["cap"].texto_original.split(" | ")) == 4


def test_page_text_rules(spark):
    html = ("<!DOCTYPE html><html><head><title>T&amp;C</title><style>p{}</style>"
            "<script>var t=\"</p>\";</script></head><body><!-- hidden --><p>a<b>b</b>&lt;c&#233;</p></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(page_text("html")).first()[0] == "T&Cab<cé"
    assert df.select(page_text("html", sep=" ")).first()[0].split() == ["T&C", "a", "b", "<cé"]


def test_page_elements_class_token(spark):
    html = ('<a class="feed-post-link x">One</a><a class="feed-post-linked">No</a>'
            '<a href="/" class=\'y feed-post-link\'>Two <b>bold</b></a>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = page_elements(df, "a", "feed-post-link").collect()
    assert [(r.ord, r.text) for r in out] == [(0, "One"), (1, "Two bold")]


def test_contingency_from_json_and_rejects(spark):
    texts = spark.createDataFrame([('{"evento":"Teste","rodovia":"Anchieta"}', "texto de teste", 1),
                                   ('{"rodovia":"Anchieta"}', "outro", 2)], "j string, t string, id long")
    out = {r.id: r for r in contingency_from_json(texts, "j", "t", RUN, ["id"]).collect()}
    assert out[1].entidade_evento == "Teste" and out[2].entidade_evento == "N/A"
    assert out[1].score_risco == 0.8 and out[1].loc_id == S.JSON_CONTINGENCY_LOC
    assert json.loads(out[1].json_extraido) == {"evento": "Teste", "rodovia": "Anchieta"}
    rows = spark.createDataFrame([('{"cont_id":"a","score_risco":0.5}',), ('{"cont_id":"b",',),
                                  ('{"cont_id":"c","score_risco":"high"}',), (None,)], "json string")
    good, bad = split_json_rows(rows, S.FATO_CONTINGENCIAS)
    assert [r.cont_id for r in good.collect()] == ["a"]
    assert bad.count() == 3
    assert good.filter(F.col("score_risco") == 0.5).count() == 1


def test_pages_of_one_file_of_orders_are_parsed_over_the_cores(spark):
    from portrisk.plans import catalog
    from tests.conftest import SF_SMALL
    pages = catalog.contingency_pages_pt(spark, SF_SMALL)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * orders
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) < orders
