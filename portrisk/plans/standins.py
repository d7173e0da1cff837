"""Domain tables derived from the driver's tables (the oracle stand-ins).

The driver's parquet tables have no port columns, so each domain table is a
column mapping over one of them; the matching DuckDB SQL (``plans/oracle``)
uses the same mapping, so both engines start from equal rows.

* line-up  = ``orders``:  ship_id = o_custkey, terminal = o_orderpriority,
  tonnage = o_totalprice, arrival and insert time = o_orderdate, unique
  tie-break lineup_id = o_orderkey; features rain = o_totalprice / 10000,
  news score = (o_orderkey % 100) / 100.
* weather  = ``events``:  loc_id = user_id, time = ts, rain = value,
  wind = props.k (NULL where k = 50, to exercise null logic), humidity =
  k / 2, tie-break event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import critical_alert

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("lineup_id"),
        F.col("o_custkey").alias("ship_id"),
        F.to_date("o_orderdate").alias("data_chegada_prevista"),
        F.col("o_orderpriority").alias("terminal"),
        F.col("o_orderstatus").alias("commodity"),
        F.col("o_totalprice").alias("quantidade_estimada"),
        F.col("o_orderdate").alias("inserido_em"),
        (F.col("o_totalprice") / F.lit(10000.0)).alias("rain_feature"),
        ((F.col("o_orderkey") % 100).cast("double") / F.lit(100.0)).alias("nlp_risk_score"),
    )


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: (event_id, loc_id, ts, precip, windspeed, humidity)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        "event_id",
        F.col("user_id").alias("loc_id"),
        F.col("ts"),
        F.col("value").alias("precip"),
        F.nullif(k, F.lit(50.0)).alias("windspeed"),
        (k / F.lit(2.0)).alias("humidity"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised readings in the ``fato_clima`` shape plus event_id."""
    r = weather_raw(spark, sf_dir)
    return r.select(
        "event_id", "loc_id", F.col("ts").alias("timestamp_leitura"),
        F.coalesce(F.nanvl("precip", F.lit(None).cast("double")), F.lit(0.0)).alias("precipitacao_mm"),
        F.col("windspeed").alias("velocidade_vento"),
        F.col("humidity").alias("umidade"),
        critical_alert("precip", "windspeed").alias("alerta_critico"),
    )
