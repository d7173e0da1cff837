"""Registered queries over the driver's tables, one per operator group.

Each entry is ``(spark, sf_dir) -> DataFrame`` and runs over whole tables.
Column names equal those of the SQL in ``plans/oracle.py``; timestamps are
returned as ``timestamp_ntz`` (wall time in UTC) so both engines print the
same value.  Queries that land files (CSV, NDJSON, streams, the cycle) write
below the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import scalars as X
from ..functions.text import page_text
from ..operators import asof, contingency, ingest, ml, reports, state
from ..session import scratch_path
from ..sources import files, html
from . import standins as SI

Query = Callable[[SparkSession, str], DataFrame]

RUN_TS = dt.datetime(2026, 1, 1, 0, 0, 0)
RUN_TS_TEXT = "2026-01-01 00:00:00"

# Stand-in rules for the news scorer on the driver's pages (the Portuguese
# defaults have no hits there; they are unit-tested on fixtures instead).
STANDIN_RULES = contingency.Rules(
    road_tiers=((("license",), 0.5, "Road: blocked"), (("token", " und "), 0.2, "Road: slow")),
    news_words=("the", "de"), news_weight=0.5, news_prefix="News: ",
    headline_chars=40, headlines_per_page=5, link_tag="a", link_class=None,
    default_text="Normal access.")


def _ntz(df: DataFrame) -> DataFrame:
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _land_parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Files of a landing that a stream reads a few at a time: longer with more data, not more of
#: them, so that a stream's micro-batches do not follow a setting of shuffles.
LANDED_FILES = 12


def _land_files(spark) -> int:
    return min(_land_parts(spark), LANDED_FILES)


def _weather_str(spark, d):
    return SI.weather(spark, d).withColumn("loc_id", F.col("loc_id").cast("string"))


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

def q_weather_normalize(spark, d):
    """P1 P2 P3 T13 on raw readings."""
    raw = SI.weather_raw(spark, d)
    return _ntz(ingest.normalize_weather(raw, time_col="ts", keep=["event_id"]))


#: Rows of a landed weather file, and of a landed page, at most (about).
FILE_ROWS, PAGE_ROWS = 50_000, 500


def _dealt(rows, key: str, most: int):
    """``rows`` dealt to writers by ``key``, a key of more than ``most`` rows to several, each row
    with its ``part`` of the key.  A row per key is counted first."""
    n = rows.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(*rows.columns), F.ceil(F.col("_n") / F.lit(most)))
    dealt = rows.join(n, F.col(key).eqNullSafe(F.col("_of"))).select(*rows.columns, part.cast("int").alias("part"))
    return dealt.repartition(_land_parts(rows.sparkSession), key, "part")


def _weather_exports(spark, d, by_location: bool = True) -> list[DataFrame]:
    """Wide exports of differing headers, the second kind partly broken: locations whose id
    leaves 13 by 97 send files without the rain column.  ``by_location`` deals the readings of a
    location to writers of its own."""
    raw = SI.weather_raw(spark, d).select(
        F.col("loc_id").alias("of"), F.col("loc_id").cast("string").alias("loc_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "precip", "windspeed", "humidity",
        F.concat(F.lit("loc, "), F.col("loc_id").cast("string")).alias("name"),
        F.lit('partly "cloudy", rain').alias("conditions"), (F.col("event_id") % 40).alias("tempmax"))
    raw = _dealt(raw, "loc_id", FILE_ROWS) if by_location else raw.repartition(_land_parts(spark))
    broken = F.col("of") % 97 == 13
    return [rows.select("loc_id", *cols) for rows, cols in (
        (raw.filter(~broken & (F.col("of") % 2 == 0)), ["name", "datetime", "tempmax", "humidity", "precip", "windspeed"]),
        (raw.filter(~broken & (F.col("of") % 2 == 1)), ["windspeed", "conditions", "precip", "datetime", "humidity"]),
        (raw.filter(broken), ["datetime", "windspeed", "humidity"]))]


def _land_weather_csv(spark, d) -> list[str]:
    """The exports in two landing folders."""
    paths = [scratch_path(spark, "weather-csv") for _ in range(2)]
    for path, rows in zip((paths[0], paths[1], paths[1]), _weather_exports(spark, d)):
        files.write_weather_csv(rows, path)
    return paths


def q_weather_csv_roundtrip(spark, d):
    """Land per-location CSV folders, read all in one scan, normalise."""
    readings = files.read_weather_csv(spark, _land_weather_csv(spark, d))
    return _ntz(ingest.normalize_weather(readings, run_ts=RUN_TS))


def q_weather_rejects(spark, d):
    """Locations whose files lack a column are reported, the others load."""
    landed = files.weather_files(spark.read, _land_weather_csv(spark, d))
    return files.weather_rejects(landed).select("loc_id", "reason").distinct()


def q_append_table(spark, d):
    """S3: two typed batches appended to a table partitioned by day, read back."""
    path = scratch_path(spark, "append")
    w = _weather_str(spark, d).withColumn("dia", F.to_date("timestamp_leitura"))
    for odd in (0, 1):
        files.append_table(w.filter(F.col("event_id") % 2 == odd), path, partition_by=["dia"])
    return _ntz(files.read_table(spark, path).select("event_id", "loc_id", "timestamp_leitura", "precipitacao_mm",
                                                     "velocidade_vento", "umidade", "alerta_critico"))


def q_table_lifecycle(spark, d):
    """Create the tables, load the weather fact from events, count, drop twice."""
    db = f"lifecycle_{uuid.uuid4().hex[:12]}"
    base = scratch_path(spark, "tables")
    made = files.create_tables(spark, db, base, partition_by={"fato_lineup": ["status_atual"]})
    w = ingest.normalize_weather(SI.weather_raw(spark, d), time_col="ts", run_ts=RUN_TS)
    files.conform(w, S.FATO_CLIMA).write.mode("append").insertInto(f"{db}.fato_clima")
    n = spark.table(f"{db}.fato_clima").count()
    gone = files.drop_tables(spark, list(S.TABLE_SCHEMAS), db)
    again = files.drop_tables(spark, list(S.TABLE_SCHEMAS), db).withColumnRenamed("outcome", "again")
    spark.sql(f"DROP DATABASE {db}")
    rows = F.when(F.col("name") == "fato_clima", F.lit(n)).otherwise(F.lit(0)).cast("bigint")
    return (made.withColumnRenamed("outcome", "created").join(gone.withColumnRenamed("outcome", "dropped"), "name")
            .join(again, "name").withColumn("rows", rows))


def _lineup_rows(spark, d):
    o = SI.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("lineup_id"),
        F.col("o_custkey").cast("string").alias("ship_id"),
        F.to_date("o_orderdate").alias("data_chegada_prevista"),
        F.col("o_orderdate").cast("timestamp").alias("data_atracacao_prevista"),
        F.lit(S.LINEUP_STATUS).alias("status_atual"),
        F.col("o_orderpriority").alias("terminal"),
        F.col("o_orderstatus").alias("commodity"),
        F.col("o_totalprice").alias("quantidade_estimada"),
        F.col("o_orderdate").cast("timestamp").alias("inserido_em"))


def q_ndjson_roundtrip(spark, d):
    """Append as NDJSON (text dates), read back schema-enforced."""
    path = scratch_path(spark, "lineup-ndjson")
    files.append_ndjson(_lineup_rows(spark, d), path)
    return _ntz(files.read_ndjson(spark, path, S.FATO_LINEUP, mode="FAILFAST"))


EVENT_ROW = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType())])


def q_insert_rejects(spark, d):
    """JSON rows; error events above 250 arrive cut short and are rejected."""
    e = SI.table(spark, d, "events")
    text = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    broken = (F.col("event_type") == "error") & (F.col("value") > 250)
    texts = e.select(F.col("event_type").alias("batch_type"),
                     F.when(broken, F.left(text, F.floor(F.length(text) / 2).cast("int")))
                     .otherwise(text).alias("json"))
    parsed = files.parse_json_rows(texts, EVENT_ROW, "json", keep=["batch_type"])
    return parsed.groupBy(F.col("batch_type").alias("event_type")).agg(
        F.count_if("accepted").cast("bigint").alias("accepted"),
        F.count_if(~F.col("accepted")).cast("bigint").alias("rejected"))


def q_scan_project(spark, d):
    """Three columns of a fact table (column pruning into the scan)."""
    return SI.table(spark, d, "events").select("event_id", "ts", "value")


def q_load_report(spark, d):
    """Rows per location of a weather batch."""
    return files.load_report(SI.weather(spark, d), "loc_id")


# ---------------------------------------------------------------------------
# Joins and latest state
# ---------------------------------------------------------------------------

STANDIN_POINTS = [("0", S.DEFAULT_POINTS[0][1], S.DEFAULT_POINTS[0][2], S.DEFAULT_POINTS[0][3]),
                  ("1", S.DEFAULT_POINTS[1][1], S.DEFAULT_POINTS[1][2], S.DEFAULT_POINTS[1][3]),
                  ("9999", S.DEFAULT_POINTS[2][1], S.DEFAULT_POINTS[2][2], S.DEFAULT_POINTS[2][3])]


def q_points_join(spark, d):
    """Literal monitored points x newest reading."""
    dim = state.points_dim(spark, STANDIN_POINTS)
    return state.map_rows(dim, _weather_str(spark, d), tie_break="event_id")


def customer_dim(spark, d):
    c = SI.table(spark, d, "customer")
    wkt = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("LINESTRING(0 0,1 1)")).otherwise(
        F.concat(F.lit("POINT(-46."), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"),
                 F.lit(" -23."), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(")")))
    return c.select(F.col("c_custkey").cast("string").alias("loc_id"),
                    F.col("c_name").alias("nome_ponto"), wkt.alias("coordenadas"),
                    F.col("c_mktsegment").alias("tipo_ponto"))


def q_latest_per_loc_map(spark, d):
    """Every dimension point with its newest reading (or none)."""
    return state.map_rows(customer_dim(spark, d), _weather_str(spark, d), tie_break="event_id")


def q_latest_per_ship(spark, d):
    """Newest line-up row per ship with local time text."""
    return state.latest_ships(SI.lineup(spark, d))


def q_latest_event(spark, d):
    """O1: newest event."""
    return state.latest_event(SI.table(spark, d, "events"), "ts", "event_id")


def q_preview(spark, d):
    """O3: five smallest keys."""
    return state.preview(SI.table(spark, d, "events"), "event_id", 5)


def q_flag_max(spark, d):
    """Every row equal to the column maximum is flagged; some readings are NaN."""
    e = SI.table(spark, d, "events")
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = state.flag_max(e.select("event_id", value.alias("value")), "value")
    return out.select("event_id", X.nan_to_null("value").alias("value"), "is_max")


def q_feature_store(spark, d):
    """Purchases with the newest view of the same user as of their time,
    plus the newest error value as a current scalar."""
    e = SI.table(spark, d, "events")
    left = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = e.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
    joined = asof.asof_join(left, right, ["user_id"], "ts", "ts",
                            {"value": "view_value", "event_id": "view_event_id"}, ["event_id"])
    errors = e.filter(F.col("event_type") == "error")
    cur = state.current_value(errors, "value", "ts", "event_id")
    return joined.withColumn("current_error_value", F.coalesce(cur, F.lit(0.0)))


def q_feature_store_view(spark, d):
    """The feature-store view over line-up batches (all rows of a batch share one insert
    stamp), the weather of one location and the news."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
                             + F.floor(F.col("lineup_id") / 500) % 29 * 86400 + 3600)
    lineup = SI.lineup(spark, d).select("lineup_id", "ship_id", "terminal", at.alias("inserido_em"))
    w = _weather_str(spark, d)
    w = w.withColumn("loc_id", F.when(F.col("event_id") % 3 == 0, F.lit("PORT")).otherwise(F.col("loc_id")))
    news = news_standin(spark, d).filter(F.col("texto_original") == "error")
    return _ntz(asof.feature_store(lineup, w, news, "PORT", weather_tie=["event_id"]))


def q_dedup_readings(spark, d):
    """E5 on the fact's own columns: a second ingest re-sends click/view readings with
    corrected rain; the last-ingested row per (location, reading time) is kept."""
    raw = SI.weather_raw(spark, d)
    e = SI.table(spark, d, "events").select("event_id", "event_type")
    resent = raw.join(e.filter(F.col("event_type").isin("click", "view")), "event_id", "left_semi")
    first = ingest.normalize_weather(raw, time_col="ts", run_ts=dt.datetime(2024, 2, 1))
    again = ingest.normalize_weather(resent.withColumn("precip", F.coalesce("precip", F.lit(0.0)) + 1.0),
                                     time_col="ts", run_ts=dt.datetime(2024, 2, 2))
    return _ntz(ingest.dedup_readings(ingest.union_batches([first, again])))


def q_union_batches(spark, d):
    """Batches of two sources with their columns in different orders, unioned by name."""
    e = SI.table(spark, d, "events").select("event_id", "event_type", "value")
    o = SI.table(spark, d, "orders").select(F.col("o_totalprice").alias("value"),
                                            F.col("o_orderkey").alias("event_id"),
                                            F.col("o_orderpriority").alias("event_type"))
    return ingest.union_batches([e, o])


# ---------------------------------------------------------------------------
# Line-up and pages
# ---------------------------------------------------------------------------

def lineup_raw(spark, d):
    """Raw line-up text columns built from orders (BR numbers, day-first dates)."""
    o = SI.table(spark, d, "orders")
    us = F.format_number("o_totalprice", 2)
    br = F.translate(F.translate(F.translate(us, ",", "#"), ".", ","), "#", ".")
    when_txt = (F.when(F.col("o_orderstatus") == "P", F.lit("sem data"))
                .when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, F.date_format(
                    "o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yy")))
                .otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm"))
                           .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))))
    return o.select(
        F.concat(F.lit("SHIP-"), F.col("o_orderkey").cast("string")).alias("Navio Ship"),
        F.when(F.col("o_custkey") % 10 != 3, F.col("o_custkey").cast("string")).alias("IMO"),
        when_txt.alias("Cheg/Arrival d/m/y"),
        F.col("o_orderstatus").alias("Mercadoria Goods"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("10D")).otherwise(br).alias("Peso Weight"),
        F.col("o_orderpriority").alias("Terminal"))


def q_lineup_clean(spark, d):
    """Raw header/text columns -> fato_lineup rows, those
    without a ship dropped."""
    named = ingest.require_columns(ingest.rename_by_substring(lineup_raw(spark, d)),
                                   ["data_chegada_prevista"])
    return _ntz(ingest.normalize_lineup(named, RUN_TS, strict=False, drop_null=True, id_keys=named.columns))


def customer_pages(spark, d):
    """HTML pages holding each nation's customers as a two-level-header table, ``PAGE_ROWS`` or so a page.

    The pages have what simple patterns get wrong: spans, missing end tags, comments,
    entities and nested tags.
    """
    c = SI.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    tr = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("<td><b>"),
                  F.replace("c_name", F.lit("#"), F.lit("&#35;&amp;")), F.lit("</b><td>"), F.col("c_nationkey").cast("string"))
    head = ("<html><body><!-- <table><tr><td>old</table> --><p>Customers</p>"
            "<table class=\"lineup\"><thead><tr><th colspan=2>Customer</th><th rowspan=2>Nation Key</th></tr>"
            "<tr><th>Key</th><th>Name</th></tr></thead><tbody>")
    pages = html.table_pages(_dealt(c.withColumn("tr", tr), "c_nationkey", PAGE_ROWS), ["c_nationkey", "part"],
                             "c_custkey", "tr", head, "</tbody></table></body></html>")
    return pages.select((F.col("c_nationkey") * 1_000_000 + F.col("part")).cast("long").alias("page_id"), "html")


def q_html_table_rows(spark, d):
    """Parse the first table of each page back into typed rows."""
    rows = html.html_tables(customer_pages(spark, d))
    named = html.table_columns(rows, [("Customer Key", "k"), ("Customer Name", "name"), ("Nation Key", "n")])
    return named.select(F.col("k").cast("long").alias("c_custkey"), F.col("name").alias("c_name"),
                        F.col("n").cast("int").alias("c_nationkey"))


def q_page_elements_div_ad(spark, d):
    """Text of every ``div.ad`` element, in document order."""
    return html.page_elements(SI.table(spark, d, "pages"), "div", "ad")


def q_page_links_first5(spark, d):
    """First five links of each page (the original reads five headlines)."""
    return html.page_elements(SI.table(spark, d, "pages"), "a", None, limit=5)


def q_page_text_hits(spark, d):
    """Visible text length and keyword flags per page (whole pages)."""
    p = SI.table(spark, d, "pages")
    t = page_text(F.col("html"))
    return p.select("page_id", t.alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("text_chars"),
        X.contains_any("t", ["license"]).alias("has_license"),
        X.contains_any("t", ["token"]).alias("has_token"),
        X.contains_any("t", ["the "]).alias("has_the"))


def contingency_pages(spark, d):
    """Each driver page is one monitoring batch: read as the road page and as the news page."""
    p = SI.table(spark, d, "pages")
    base = p.select("page_id", F.col("page_id").cast("string").alias("batch_id"), "html")
    return base.withColumn("kind", F.lit("road")).unionByName(base.withColumn("kind", F.lit("news")))


def q_contingency_score(spark, d):
    """One scored contingency row per batch."""
    return _ntz(contingency.score_contingencies(contingency_pages(spark, d), RUN_TS, STANDIN_RULES))


def q_contingency_json(spark, d):
    """Extracted JSON -> contingency rows (event key default N/A)."""
    e = SI.table(spark, d, "events")
    out = contingency.contingency_from_json(e, "props", "event_type", RUN_TS, ["event_id"])
    return _ntz(out.withColumn("k", X.json_key(F.col("json_extraido"), "k")))


def contingency_pages_pt(spark, d):
    """Portuguese road and news pages of each order, written with entities and nested tags.

    The orders are dealt to tasks by row: parsing their pages is the work, and a file's few bytes
    would give it few tasks."""
    o = SI.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").repartition(
        _land_parts(spark), "o_orderkey")
    road = (F.when(F.col("o_orderstatus") == "F", F.lit("Interdi&ccedil;&atilde;o <b>total</b>"))
            .when(F.col("o_orderstatus") == "O", F.lit("Tr&#225;fego <i>intenso</i>")).otherwise(F.lit("Livre &#x110000;")))
    head = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Paralisa&ccedil;&atilde;o dos <b>portu&aacute;rios</b> "))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("GREVE &amp; protesto no cais, dia ")).otherwise(F.lit("Festa dia ")))
    link = F.concat(F.lit("<a class='x feed-post-link' href=#>"), head, F.col("o_orderkey").cast("string"), F.lit("</a>"))
    base = o.select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").cast("string").alias("batch_id"),
                    F.concat(F.lit("<div><script>if (a<b) greve</script><p>"), road, F.lit("</div>")).alias("road"),
                    F.concat(F.lit("<div data-class='feed-post-link'>greve</div>"), link,
                             F.lit("<a class=other>greve</a>")).alias("news"))
    return base.select("page_id", "batch_id", F.lit("road").alias("kind"), F.col("road").alias("html")).unionByName(
        base.select("page_id", "batch_id", F.lit("news").alias("kind"), F.col("news").alias("html")))


def q_contingency_portuguese(spark, d):
    """X1 X3 X5 with the default rules on Portuguese pages."""
    return _ntz(contingency.score_contingencies(contingency_pages_pt(spark, d), RUN_TS))


def q_row_id(spark, d):
    """Key hash ids with a fixed run stamp (retry-stable); keys hold NULL and '|'."""
    o = SI.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.concat(F.col("o_orderstatus"), F.lit("|"), F.col("o_orderpriority")).alias("tag"))
    return ingest.with_row_id(o.withColumn("run_ts", F.lit(RUN_TS_TEXT)), "row_id",
                              ["o_custkey", "tag", "o_orderkey", "run_ts"]).drop("run_ts", "tag")


def q_headline_trunc(spark, d):
    """T6 on whole documents: headline text plus whole-text length and flag."""
    doc = SI.table(spark, d, "documents")
    return doc.select("doc_id", X.headline("text", 40).alias("headline"),
                      F.length("text").cast("bigint").alias("text_chars"),
                      X.contains_any("text", ["license"]).alias("has_license"))


def q_local_timestamp(spark, d):
    """T4: UTC stamps as Sao Paulo wall-clock text."""
    e = SI.table(spark, d, "events")
    return e.select("event_id", X.format_local("ts").alias("local_text"))


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------

def _ships(spark, d):
    return state.latest_ships(SI.lineup(spark, d))


def q_fleet_kpis(spark, d):
    """A1 over the latest ships."""
    k = reports.fleet_kpis(_ships(spark, d))
    return _ntz(k.select("n_ships", F.round("mean_rain_mm", 6).alias("mean_rain_mm"),
                         F.round("mean_nlp_risk_pct", 6).alias("mean_nlp_risk_pct"), "last_update"))


def news_standin(spark, d):
    e = SI.table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("cont_id"),
                    F.col("ts").alias("timestamp_leitura"),
                    (F.col("value") / F.lit(500.0)).alias("score_risco"),
                    F.col("event_type").alias("texto_original"))


def q_access_risk_kpi(spark, d):
    """Newest news score x100 and its tier."""
    r = reports.access_risk(news_standin(spark, d))
    return r.select(F.round("access_risk_pct", 6).alias("access_risk_pct"), "tier", "texto_original")


def q_volume_by_terminal(spark, d):
    """A3: tonnage per terminal over the latest ships."""
    v = reports.volume_by_terminal(_ships(spark, d))
    return v.select("terminal", F.round("total_volume", 2).alias("total_volume"),
                    F.round("mean_rain_mm", 6).alias("mean_rain_mm"), "n_ships")


def q_rain_segments(spark, d):
    """A3: the stacked bars, tonnage of each (terminal, rain) segment."""
    v = reports.rain_segments(_ships(spark, d).withColumn("rain_feature", F.floor("rain_feature").cast("double")))
    return v.select("terminal", "rain_feature", F.round("volume", 2).alias("volume"), "n_ships")


def q_formatted_kpis(spark, d):
    """Presentation texts of each terminal's figures."""
    v = reports.volume_by_terminal(_ships(spark, d))
    return v.select("terminal", X.fmt("total_volume", ".2f").alias("volume"), X.fmt("mean_rain_mm", ".1f mm").alias("rain"),
                    X.fmt(F.col("n_ships") / 1000.0, ".1%").alias("share"))


def q_top_terminals(spark, d):
    """A4 O2: top five terminals by line-up rows."""
    return reports.value_counts(SI.lineup(spark, d), "terminal", 5)


def q_top_ships(spark, d):
    """A4 O2: top five ships by line-up rows (ties by id)."""
    return reports.value_counts(SI.lineup(spark, d), "ship_id", 5)


def q_arrivals_by_date(spark, d):
    """Arrivals per date."""
    return reports.arrivals_by_date(SI.lineup(spark, d))


def q_class_share(spark, d):
    """Normalised value counts of a label."""
    s = reports.class_share(SI.table(spark, d, "labels"), "quality")
    return s.select("quality", "count", F.round("share", 9).alias("share"))


def q_describe_weather(spark, d):
    """describe() of the three weather measures, long form."""
    return reports.describe_columns(SI.weather(spark, d),
                                    ["precipitacao_mm", "velocidade_vento", "umidade"], digits=6)


def q_rain_histogram(spark, d):
    """Equal-width bins over the rain range, their number chosen from the data."""
    h = reports.histogram(SI.weather(spark, d), "precipitacao_mm")
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


def q_rain_kde(spark, d):
    """Exact Gaussian KDE of rain on a 200-point grid (Scott bandwidth)."""
    k = reports.kde(SI.weather(spark, d), "precipitacao_mm", grid_size=200)
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _label_pred(spark, d):
    lab = SI.table(spark, d, "labels")
    return lab.select(F.col("quality").alias("label"), (F.lit(1) - F.col("toxic")).alias("prediction"))


def q_confusion_matrix(spark, d):
    """A10: label x prediction counts (labels: quality vs 1 - toxic)."""
    return reports.confusion_matrix(_label_pred(spark, d))


def q_classification_report(spark, d):
    """precision/recall/F1/support, accuracy, macro and weighted averages."""
    r = reports.classification_report(_label_pred(spark, d))
    return r.select("row_label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")],
                    "support")


# ---------------------------------------------------------------------------
# Model
# ---------------------------------------------------------------------------

def lineitem_features(spark, d):
    li = SI.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_discount") * F.lit(1000.0)).alias("rain_feature"),
        (F.col("l_quantity") * F.lit(1.2)).alias("wind_feature"),
        (F.col("l_tax") * F.lit(12.5)).alias("nlp_risk_score"),
        F.col("l_extendedprice").alias("quantidade_estimada"))


def q_rule_label(spark, d):
    """Rule label over features derived from lineitem, some of them NaN."""
    nan = F.lit(float("nan"))
    f = lineitem_features(spark, d).withColumn(
        "wind_feature", F.when(F.col("l_linenumber") == 6, nan).otherwise(F.col("wind_feature")))
    out = ml.label_features(f)
    return out.withColumn("wind_feature", X.nan_to_null("wind_feature"))


def _synth(spark, d):
    o = SI.table(spark, d, "orders").select("o_orderkey")
    return ml.label_features(ml.synth_features(o, "o_orderkey"))


def q_synth_features(spark, d):
    """M1 M2: one synthetic model row per order key (integer LCG uniforms)."""
    return _synth(spark, d)


def q_split_hash(spark, d):
    """M4: 80/20 split by key hash; rows and positives per side."""
    s = _synth(spark, d).withColumn("side", F.when(ml.split_flag(F.col("o_orderkey")), "test")
                                    .otherwise("train"))
    return s.groupBy("side").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                 F.sum(S.MODEL_LABEL).cast("bigint").alias("positives"))


_PATHS: dict[tuple[str, str], str] = {}
_MODELS: dict[tuple[str, str], object] = {}


def model_path(spark, d, synth: DataFrame | None = None) -> str:
    """Fit once per session and table dir and save to the shared dir, which other
    processes read; its trees are read from there without the model."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PATHS:
        train, _ = ml.train_test_split(_synth(spark, d) if synth is None else synth, "o_orderkey")
        _PATHS[key] = ml.fit_saved(train, path=scratch_path(spark, "risk-model"))  # the forest persists its own bagged input
    return _PATHS[key]


def trained_model(spark, d, synth: DataFrame | None = None):
    """The saved model, loaded once per session and table dir."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = ml.load_model(model_path(spark, d, synth))
    return _MODELS[key]


def q_model_fit(spark, d):
    """Fit the forest anew, save it and read its trees back: nodes and leaves per tree."""
    train, _ = ml.train_test_split(_synth(spark, d), "o_orderkey", stratify=S.MODEL_LABEL)
    path = ml.fit_saved(train, path=scratch_path(spark, "risk-fit"))
    return ml.forest_nodes(spark, path).groupBy("tree").agg(
        F.count(F.lit(1)).cast("bigint").alias("nodes"), F.count_if(F.col("left") < 0).cast("bigint").alias("leaves"))


def q_split_stratified(spark, d):
    """M4: 80/20 split that keeps the classes' shares; rows per side and class."""
    train, test = ml.train_test_split(_synth(spark, d), "o_orderkey", stratify=S.MODEL_LABEL)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", S.MODEL_LABEL).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


def q_model_evaluation(spark, d):
    """Confusion matrix of the forest on the held-out split."""
    synth = _synth(spark, d)
    _, test = ml.train_test_split(synth, "o_orderkey")
    cm, _ = ml.evaluate(ml.score(trained_model(spark, d, synth), ml.sized(test)))
    return cm


def q_importances(spark, d):
    """M6: feature importances from the saved trees' nodes."""
    return ml.importances(ml.forest_nodes(spark, model_path(spark, d)))


def _fleet(spark, d):
    ships = _ships(spark, d)
    return ships.withColumn("wind_feature", (F.col("ship_id") % 60).cast("double"))


def q_score_fleet(spark, d):
    """Every latest ship scored and tiered."""
    out = ml.score_fleet(trained_model(spark, d), _fleet(spark, d))
    return _ntz(out.select("ship_id", "lineup_id", "terminal", "risk_probability", "prediction", "tier"))


def q_sensitivity_sweep(spark, d):
    """M8: wind 0..80 step 5 over every ship of the fleet (partial dependence)."""
    base = _fleet(spark, d).select(*S.MODEL_FEATURES)
    return ml.sweep(trained_model(spark, d), base, "wind_feature", nodes=ml.forest_nodes(spark, model_path(spark, d)))


def _news_now(spark, d):
    return state.current_value(news_standin(spark, d), "score_risco", "timestamp_leitura", "cont_id")


def q_stress_test(spark, d):
    """M8: the fleet at the current news score under every wind 0..80 and every rain 0..100."""
    nodes = ml.forest_nodes(spark, model_path(spark, d))
    base = _fleet(spark, d).select(*S.MODEL_FEATURES).withColumn("nlp_risk_score", F.coalesce(_news_now(spark, d), F.lit(0.0)))
    return ml.sweeps(trained_model(spark, d), nodes, base, {"wind_feature": range(81), "rain_feature": range(101)})


def q_forest_walk(spark, d):
    """The fleet scored by the model and by a walk of its saved trees: ships, and
    those whose probability (to 1e-9) or class differs."""
    nodes = ml.forest_nodes(spark, model_path(spark, d))
    both = ml.walk(nodes, ml.score(trained_model(spark, d), ml.sized(_fleet(spark, d).select("ship_id", *S.MODEL_FEATURES))))
    apart = F.abs(F.col("risk_probability") - F.col("walk_probability")) > 1e-9
    return both.agg(F.count(F.lit(1)).alias("ships"), F.count_if(F.coalesce(apart, F.lit(True))).alias("other_probability"),
                    F.count_if(F.col("prediction") != F.col("walk_prediction")).alias("other_class"))


def _surface(spark, d):
    nodes = ml.forest_nodes(spark, model_path(spark, d))
    return ml.risk_surface(trained_model(spark, d), nodes, _fleet(spark, d), _news_now(spark, d)), nodes


def q_risk_surface(spark, d):
    """Per terminal, the risk at every setting of the simulator, as cells of equal risk."""
    return _surface(spark, d)[0]


def q_risk_surface_check(spark, d):
    """M9: settings that the cells of each terminal hold, and settings made from its ships that
    the model scores otherwise than their cell says (to 1e-9)."""
    surface, nodes = _surface(spark, d)
    surface = files.read_table(spark, _written(spark, surface))
    size = lambda f: F.col(f"{f}_to").cast("long") - F.col(f"{f}_from") + 1
    held = surface.groupBy("terminal").agg(
        F.sum(size("quantidade_estimada") * size("rain_feature") * size("wind_feature")).alias("settings"))
    at = _fleet(spark, d).select(
        "terminal", (F.pmod(F.floor("quantidade_estimada"), F.lit(145001)) + 5000).alias("quantidade_estimada"),
        (F.col("ship_id") % 101).alias("rain_feature"), (F.col("lineup_id") % 51).alias("wind_feature"),
        F.coalesce(_news_now(spark, d), F.lit(0.0)).alias("nlp_risk_score"))
    asked = ml.surface_at(surface, at, nodes)
    scored = ml.score(trained_model(spark, d), ml.sized(asked))
    apart = F.abs(F.col("risk_probability") - F.col("surface_probability")) > 1e-9
    found = scored.groupBy("terminal").agg(F.count(F.lit(1)).alias("ships"), F.count_if(apart).alias("other_probability"))
    return held.join(found, "terminal")


def _written(spark, df) -> str:
    path = scratch_path(spark, "surface")
    df.write.parquet(path)
    return path


def q_scenario_grid(spark, d):
    """Per terminal, tonnage x rain x wind surface at the current news score."""
    cur = state.current_value(news_standin(spark, d), "score_risco", "timestamp_leitura", "cont_id")
    g = ml.scenario_grid(trained_model(spark, d), _fleet(spark, d), cur, tonnage_values=S.SCENARIO_TONNAGE_LEVELS)
    return g.select("terminal", "quantidade_estimada", "rain_feature", "wind_feature", "nlp_risk_score",
                    "risk_probability", "tier")


# ---------------------------------------------------------------------------
# Line-up pages, streams and the cycle
# ---------------------------------------------------------------------------

LINEUP_HEADERS = ["Navio Ship", "IMO", "Cheg/Arrival d/m/y", "Mercadoria Goods", "Peso Weight", "Terminal"]


def lineup_pages(spark, d):
    """Landed line-up pages of each customer, ``PAGE_ROWS`` orders or so each: a table with the
    header row and a row per order."""
    raw = lineup_raw(spark, d)
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in LINEUP_HEADERS) + "</tr>"
    cells = [F.concat(F.lit("<td>"), F.coalesce(F.col(f"`{h}`"), F.lit(""))) for h in LINEUP_HEADERS]
    rows = raw.select(F.regexp_extract(F.col("`Navio Ship`"), r"([0-9]+)$", 1).cast("long").alias("key"),
                      F.concat(F.lit("<tr>"), *cells).alias("tr")).join(
        SI.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("page_id")), "key")
    body = html.table_pages(_dealt(rows, "page_id", PAGE_ROWS), ["page_id", "part"], "key", "tr",
                            "<html><body><h2>Navios esperados</h2>" + head, "</table></body></html>")
    return body.select("page_id", F.col("page_id").cast("string").alias("batch_id"), F.lit("lineup").alias("kind"), "html")


def q_lineup_pages(spark, d):
    """Landed line-up pages -> fato_lineup rows."""
    return _ntz(ingest.lineup_from_pages(lineup_pages(spark, d), RUN_TS, strict=True))


def _await(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


#: Weather files of a stream's micro-batch: with ``FILE_ROWS`` readings each at most, micro-batches
#: are bounded and follow readings.
STREAM_FILES = 100


def q_stream_weather(spark, d):
    """Landed weather CSV, of which each reading names its location, read as a stream -> P1 ->
    appended table, restarted for each kind of export that lands."""
    from ..streaming import streams
    out, ckpt = scratch_path(spark, "stream-weather"), scratch_path(spark, "ckpt-weather")
    landing = scratch_path(spark, "landing-weather")
    for rows in _weather_exports(spark, d, by_location=False):  # the next ones land after the stream has stopped
        files.write_weather_exports(rows, landing, FILE_ROWS)
        _await(streams.weather_stream(spark, landing, out, ckpt, run_ts=RUN_TS, max_files=STREAM_FILES))
    return _ntz(spark.read.parquet(out))


def _land_events(spark, d, repeats: bool) -> str:
    """Land weather readings as parquet; with ``repeats`` the click/view readings are landed a
    second time as exact copies (the 15-day re-fetch), some readings have no location, and
    some are empty ones without a time, many of them alike."""
    w = (SI.weather(spark, d).withColumn("loc_id", F.col("loc_id").cast("string"))
         .withColumn("timestamp_leitura", F.col("timestamp_leitura").cast("timestamp")))
    if repeats:
        timeless, homeless = F.col("event_id") % 50 == 9, F.col("event_id") % 50 == 7
        kind = F.when(timeless, 1).when(homeless, 2).otherwise(0)
        w = w.select(*[(F.when(kind != 2, F.col(c)) if c == "loc_id" else F.when(kind != 1, F.col(c))).alias(c)
                       for c in w.columns], F.col("event_id").alias("sent_id"))
    path = scratch_path(spark, "landing-events")
    w.drop("sent_id").repartition(_land_files(spark)).write.mode("append").parquet(path)
    if repeats:
        e = SI.table(spark, d, "events").select(F.col("event_id").alias("sent_id"), "event_type")
        w.join(e.filter(F.col("event_type").isin("click", "view")), "sent_id", "left_semi") \
            .drop("sent_id").repartition(_land_files(spark)).write.mode("append").parquet(path)
    return path


def q_stream_latest(spark, d):
    """Newest reading per location merged into one table over several micro-batches."""
    from ..streaming import streams
    landing = _land_events(spark, d, repeats=False)
    schema = spark.read.parquet(landing).schema
    out, ckpt = scratch_path(spark, "stream-latest"), scratch_path(spark, "ckpt-latest")
    for _ in range(2):  # the second start finds nothing new
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(landing)
        _await(streams.latest_stream(src, ["loc_id"], ["timestamp_leitura", "event_id"], out, ckpt))
    return _ntz(streams.read_latest(spark, out).select("loc_id", "timestamp_leitura", "precipitacao_mm",
                                                       "velocidade_vento", "alerta_critico", "event_id"))


def q_stream_dedup(spark, d):
    """Repeated readings dropped over several micro-batches, late first ones kept."""
    from ..streaming import streams
    landing = _land_events(spark, d, repeats=True)
    schema = spark.read.parquet(landing).schema
    out, ckpt = scratch_path(spark, "stream-dedup"), scratch_path(spark, "ckpt-dedup")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(landing)
    _await(streams.dedup_stream(src, ["loc_id", "timestamp_leitura"], "timestamp_leitura", out, ckpt))
    return _ntz(streams.read_deduplicated(spark, out))


def _land_pages(spark, df: DataFrame, path: str) -> str:
    # landing produces several files (one per writer task), as a real landing zone does
    df.select(F.col("page_id").cast("long"), F.col("batch_id").cast("string"), "kind", "html") \
        .repartition(_land_files(spark)).write.mode("append").parquet(path)
    return path


def q_stream_contingency(spark, d):
    """Road pages land and are scored, the batches' news pages later; a row per batch."""
    from ..streaming import streams
    pages = contingency_pages(spark, d)
    pages = pages.withColumn("batch_id", F.when(F.col("page_id") % 40 != 3, F.col("batch_id")))  # the rest is a batch too
    out, ckpt = scratch_path(spark, "stream-news"), scratch_path(spark, "ckpt-news")
    landing = scratch_path(spark, "landing-news")
    for kind in ("road", "news"):
        _land_pages(spark, pages.filter(F.col("kind") == kind), landing)
        _await(streams.contingency_stream(spark, landing, out, ckpt, lambda epoch: RUN_TS, STANDIN_RULES, max_files=4,
                                          buckets=16))
    return _ntz(streams.read_contingencies(spark, out))


def q_stream_lineup(spark, d):
    """R2: landed line-up pages read as a stream -> X2 -> appended table."""
    from ..streaming import streams
    landing = _land_pages(spark, lineup_pages(spark, d), scratch_path(spark, "landing-lineup"))
    out, ckpt = scratch_path(spark, "stream-lineup"), scratch_path(spark, "ckpt-lineup")
    _await(streams.lineup_stream(spark, landing, out, ckpt, RUN_TS, max_files=3))
    return _ntz(spark.read.parquet(out))


def q_run_cycle(spark, d):
    """One hourly cycle over landed weather, line-up and news files; the rows of the
    three tables it wrote."""
    from .cycle import run_cycle
    landing = scratch_path(spark, "landing-cycle")
    raw = SI.weather_raw(spark, d).select(
        F.col("loc_id").cast("string").alias("loc_id"), "humidity", "precip", "windspeed",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"))
    files.write_weather_exports(raw.repartition(_land_parts(spark)), f"{landing}/weather", FILE_ROWS)
    lineup_pages(spark, d).repartition(_land_parts(spark)).write.parquet(f"{landing}/lineup")
    contingency_pages(spark, d).select("page_id", "batch_id", "kind", "html").repartition(_land_parts(spark)) \
        .write.parquet(f"{landing}/news")
    wh = scratch_path(spark, "warehouse")
    steps = run_cycle(spark, landing, wh, RUN_TS, STANDIN_RULES).filter("outcome <> 'ok'").collect()  # three rows
    if steps:
        raise RuntimeError(str(steps))
    shape = lambda name, key, at, amount, text: files.read_table(spark, f"{wh}/{name}").select(
        F.lit(name).alias("table_name"), F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at_time"),
        F.col(amount).alias("amount"), F.col(text).cast("string").alias("text"))
    rows = [shape("fato_clima", "loc_id", "timestamp_leitura", "precipitacao_mm", "alerta_critico"),
            shape("fato_lineup", "lineup_id", "data_atracacao_prevista", "quantidade_estimada", "terminal"),
            shape("fato_contingencias_nlp", "cont_id", "timestamp_leitura", "score_risco", "texto_original")]
    return _ntz(ingest.union_batches(rows))


def q_dashboard_map_sql(spark, d):
    """J1 E2 T9 through Spark SQL: stand-in tables registered as views, the map
    query run as SQL text with the SQL-bodied point functions."""
    from .views import DASHBOARD_SQL, register_views
    register_views(spark, tables={"fato_clima": _repeated_weather(spark, d),
                                  "dim_geografia_rota": customer_dim(spark, d)})
    return spark.sql(DASHBOARD_SQL["map"])


def _repeated_weather(spark, d):
    """The weather fact with every reading fetched twice, the second time with more rain."""
    w = _weather_str(spark, d).withColumn("timestamp_leitura", F.col("timestamp_leitura").cast("timestamp"))
    stamp = lambda day: F.lit(dt.datetime(2024, 2, day)).cast("timestamp")
    return w.withColumn("inserido_em", stamp(1)).unionByName(
        w.withColumn("inserido_em", stamp(2)).withColumn("precipitacao_mm", F.col("precipitacao_mm") + 1.0))


def _dashboard_tables(spark, d) -> dict:
    at = lambda n: F.timestamp_seconds(F.lit(1704067200) + F.col(n) % 29 * 86400)
    lineup = SI.lineup(spark, d).select(F.col("lineup_id").cast("string").alias("lineup_id"),
                                        F.col("ship_id").cast("string").alias("ship_id"), "terminal",
                                        at("lineup_id").alias("inserido_em"))
    news = news_standin(spark, d).withColumn("timestamp_leitura", F.col("timestamp_leitura").cast("timestamp"))
    w = _repeated_weather(spark, d)
    w = w.withColumn("loc_id", F.when(F.col("event_id") % 3 == 0, F.lit("PORT")).otherwise(F.col("loc_id")))
    return {"fato_lineup": lineup, "fato_clima": w, "fato_contingencias_nlp": news}


def q_dashboard_ships_sql(spark, d):
    """E1 J2 T4 through Spark SQL: the dashboard's ship query over the feature-store view."""
    from .views import DASHBOARD_SQL, register_views
    register_views(spark, tables=_dashboard_tables(spark, d), port_loc="PORT")
    return _ntz(spark.sql(DASHBOARD_SQL["ships"]))


def q_dashboard_nlp_sql(spark, d):
    """O1 through Spark SQL: the dashboard's news query."""
    from .views import DASHBOARD_SQL, register_views
    register_views(spark, tables={"fato_contingencias_nlp": _dashboard_tables(spark, d)["fato_contingencias_nlp"]})
    return _ntz(spark.sql(DASHBOARD_SQL["nlp"]))


QUERIES: dict[str, Query] = {
    "weather_normalize": q_weather_normalize,
    "weather_csv_roundtrip": q_weather_csv_roundtrip,
    "weather_rejects": q_weather_rejects,
    "append_table": q_append_table,
    "table_lifecycle": q_table_lifecycle,
    "ndjson_roundtrip": q_ndjson_roundtrip,
    "insert_rejects": q_insert_rejects,
    "scan_project": q_scan_project,
    "load_report": q_load_report,
    "points_join": q_points_join,
    "latest_per_loc_map": q_latest_per_loc_map,
    "latest_per_ship": q_latest_per_ship,
    "latest_event": q_latest_event,
    "preview": q_preview,
    "flag_max": q_flag_max,
    "feature_store": q_feature_store,
    "feature_store_view": q_feature_store_view,
    "dedup_readings": q_dedup_readings,
    "union_batches": q_union_batches,
    "lineup_clean": q_lineup_clean,
    "html_table_rows": q_html_table_rows,
    "page_elements_div_ad": q_page_elements_div_ad,
    "page_links_first5": q_page_links_first5,
    "page_text_hits": q_page_text_hits,
    "contingency_score": q_contingency_score,
    "contingency_json": q_contingency_json,
    "contingency_portuguese": q_contingency_portuguese,
    "row_id": q_row_id,
    "headline_trunc": q_headline_trunc,
    "local_timestamp": q_local_timestamp,
    "fleet_kpis": q_fleet_kpis,
    "access_risk_kpi": q_access_risk_kpi,
    "volume_by_terminal": q_volume_by_terminal,
    "rain_segments": q_rain_segments,
    "formatted_kpis": q_formatted_kpis,
    "top_terminals": q_top_terminals,
    "top_ships": q_top_ships,
    "arrivals_by_date": q_arrivals_by_date,
    "class_share": q_class_share,
    "describe_weather": q_describe_weather,
    "rain_histogram": q_rain_histogram,
    "rain_kde": q_rain_kde,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "rule_label": q_rule_label,
    "synth_features": q_synth_features,
    "split_hash": q_split_hash,
    "split_stratified": q_split_stratified,
    "model_fit": q_model_fit,
    "model_evaluation": q_model_evaluation,
    "importances": q_importances,
    "score_fleet": q_score_fleet,
    "sensitivity_sweep": q_sensitivity_sweep,
    "stress_test": q_stress_test,
    "forest_walk": q_forest_walk,
    "risk_surface": q_risk_surface,
    "risk_surface_check": q_risk_surface_check,
    "scenario_grid": q_scenario_grid,
    "lineup_pages": q_lineup_pages,
    "stream_weather": q_stream_weather,
    "stream_latest": q_stream_latest,
    "stream_dedup": q_stream_dedup,
    "stream_contingency": q_stream_contingency,
    "stream_lineup": q_stream_lineup,
    "run_cycle": q_run_cycle,
    "dashboard_map_sql": q_dashboard_map_sql,
    "dashboard_ships_sql": q_dashboard_ships_sql,
    "dashboard_nlp_sql": q_dashboard_nlp_sql,
}
