"""SQL entry points: warehouse tables and the feature-store view as temp views,
SQL functions for the helpers SQL lacks, and the dashboard queries in Spark SQL.

A user who ran the dashboard's SQL against a warehouse can run the same
queries here with ``spark.sql(DASHBOARD_SQL[...])`` after ``register_views``.
The SQL functions are SQL-bodied (``CREATE TEMPORARY FUNCTION ... RETURN``), so
Catalyst inlines them like built-ins; no Python runs per row.  Spark 4.1 has
no ``QUALIFY``, so "newest row per key" is a ``row_number() = 1`` filter,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..functions.scalars import NUMBER_PATTERN, POINT_PATTERN
from ..operators.asof import feature_store
from ..sources.files import read_table


def _lit(text: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SQL_FUNCTIONS = [
    # WKT POINT(x y) -> x / y; any other text -> NULL
    f"""CREATE OR REPLACE TEMPORARY FUNCTION point_x(wkt STRING) RETURNS DOUBLE
        RETURN try_cast(nullif(regexp_extract(wkt, {_lit(POINT_PATTERN)}, 1), '') AS DOUBLE)""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION point_y(wkt STRING) RETURNS DOUBLE
        RETURN try_cast(nullif(regexp_extract(wkt, {_lit(POINT_PATTERN)}, 2), '') AS DOUBLE)""",
    # UTC timestamp -> local wall-clock text (T4)
    f"""CREATE OR REPLACE TEMPORARY FUNCTION format_local(ts TIMESTAMP) RETURNS STRING
        RETURN date_format(from_utc_timestamp(ts, {_lit(S.LOCAL_TZ)}), {_lit(S.LOCAL_FORMAT)})""",
    # Brazilian number text -> double, bad text -> 0
    """CREATE OR REPLACE TEMPORARY FUNCTION br_number(txt STRING) RETURNS DOUBLE
        RETURN coalesce(CASE WHEN replace(replace(trim(txt), '.', ''), ',', '.') RLIKE """ + _lit(NUMBER_PATTERN) + """
                        THEN try_cast(replace(replace(trim(txt), '.', ''), ',', '.') AS DOUBLE) END, 0D)""",
]

DASHBOARD_SQL = {
    # newest feature-store row per ship, with local time text
    "ships": """
        SELECT * EXCEPT (_rn) FROM (
          SELECT *, format_local(inserido_em) AS data_formatada,
                 row_number() OVER (PARTITION BY ship_id
                                    ORDER BY inserido_em DESC, lineup_id DESC) AS _rn
          FROM view_feature_store_ml WHERE ship_id IS NOT NULL)
        WHERE _rn = 1""",
    # newest news/road risk row
    "nlp": """
        SELECT texto_original, score_risco, timestamp_leitura FROM fato_contingencias_nlp
        ORDER BY timestamp_leitura DESC, cont_id DESC LIMIT 1""",
    # map points with their newest reading (facts reduced before the join)
    "map": """
        WITH latest AS (
          SELECT loc_id, precipitacao_mm, velocidade_vento, alerta_critico FROM (
            SELECT *, row_number() OVER (PARTITION BY loc_id
                                         ORDER BY timestamp_leitura DESC, inserido_em DESC) AS _rn
            FROM fato_clima)
          WHERE _rn = 1)
        SELECT g.loc_id, g.nome_ponto, point_y(g.coordenadas) AS lat, point_x(g.coordenadas) AS lon,
               g.tipo_ponto, c.precipitacao_mm, c.velocidade_vento, c.alerta_critico
        FROM dim_geografia_rota g LEFT JOIN latest c ON g.loc_id = c.loc_id""",
    # EDA scans
    "weather_all": "SELECT * FROM fato_clima",
    "lineup_all": "SELECT * FROM fato_lineup",
}


def register_functions(spark: SparkSession) -> None:
    for stmt in SQL_FUNCTIONS:
        spark.sql(stmt)


def register_views(spark: SparkSession, warehouse: str | None = None,
                   tables: dict[str, DataFrame] | None = None,
                   port_loc: str = S.DEFAULT_POINTS[0][0]) -> list[str]:
    """Register the fact/dimension tables (from ``warehouse/<name>`` parquet or
    given DataFrames) and ``view_feature_store_ml`` (J2 over them) as temp
    views, plus the SQL functions.  Returns the registered view names."""
    register_functions(spark)
    frames = dict(tables or {})
    if warehouse:
        for name, schema in S.TABLE_SCHEMAS.items():
            if name not in frames:
                path = f"{warehouse.rstrip('/')}/{name}"
                try:
                    spark.read.parquet(path).schema
                except AnalysisException as e:  # a table not written yet is not registered
                    if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                        raise
                    continue
                frames[name] = read_table(spark, path, schema)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    names = list(frames)
    if {"fato_lineup", "fato_clima", "fato_contingencias_nlp"} <= set(frames):
        fs = feature_store(frames["fato_lineup"], frames["fato_clima"],
                           frames["fato_contingencias_nlp"], port_loc)
        fs.createOrReplaceTempView("view_feature_store_ml")
        names.append("view_feature_store_ml")
    return names
