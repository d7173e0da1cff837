"""Latest state per key, newest event, map rows and scalar attachment.

E1/E2 are written as a keyed aggregate (``max_by`` of the whole row by its
ordering struct) rather than ``ROW_NUMBER() = 1``: the aggregate combines
map-side before the shuffle, so a key holding a third of all rows still sends
at most one row per map task across the network.  Ordering follows the
original SQL: newest first with NULL times last, then a mandatory unique
tie-break (the original has none, so its pick among ties is arbitrary).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import format_local, nan_to_null, point_x, point_y


def _as_list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def latest_per_key(df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str],
                   tie_break: str | Sequence[str]) -> DataFrame:
    """The newest row per key (``order_by`` descending, NULLs last, then
    ``tie_break`` descending).  Output keeps the input columns and order.

    Struct comparison puts a NULL field below any value, which is exactly
    "descending, NULLs last" when taking the maximum.
    """
    keys = _as_list(keys)
    order = _as_list(order_by) + _as_list(tie_break)
    cols = df.columns
    ordering = F.struct(*[F.col(c) for c in order])
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_row")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def latest_ships(features: DataFrame, ship_col: str = "ship_id",
                 ts_col: str = "inserido_em", tie_break: str = "lineup_id",
                 tz: str = S.LOCAL_TZ) -> DataFrame:
    """Dashboard ship query: non-null ships, newest row each, plus local time text."""
    live = features.filter(F.col(ship_col).isNotNull())
    latest = latest_per_key(live, ship_col, ts_col, tie_break)
    return latest.withColumn("data_formatada", format_local(F.col(ts_col), tz))


def flag_max(df: DataFrame, col: str, flag: str = "is_max") -> DataFrame:
    """Flag every row equal to the column maximum (ties included).

    The maximum is a scalar subquery (partial + final aggregate, one value),
    not a keyless window, so no single task sees all rows.  NaN counts as
    missing: it is no maximum and is not flagged.
    """
    value = nan_to_null(col) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else F.col(col)
    top = df.select(F.max(value)).scalar()
    return df.withColumn(flag, F.coalesce(value == top, F.lit(False)))


def latest_event(df: DataFrame, ts_col: str, tie_break: str | Sequence[str]) -> DataFrame:
    """O1: the newest row (0 rows when empty).  Plans as a distributed top-1."""
    order = [F.col(ts_col).desc_nulls_last()] + [F.col(c).desc() for c in _as_list(tie_break)]
    return df.orderBy(*order).limit(1)


def preview(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    """O3: the first ``n`` rows by an explicit order (``head()`` made deterministic)."""
    return df.orderBy(*_as_list(order_by)).limit(n)


def current_value(df: DataFrame, value_col: str, ts_col: str,
                  tie_break: str | Sequence[str]) -> Column:
    """Newest ``value_col`` as a scalar-subquery Column (NULL when empty)."""
    ordering = F.struct(F.col(ts_col), *[F.col(c) for c in _as_list(tie_break)])
    return df.select(F.max_by(F.col(value_col), ordering)).scalar()


def with_current_score(df: DataFrame, news: DataFrame, score_col: str = "score_risco",
                       ts_col: str = "timestamp_leitura", tie_break: str = "cont_id",
                       out_col: str = "nlp_risk_score", default: float = 0.0) -> DataFrame:
    """Attach the newest news score to every row; no news -> ``default``.

    One scalar computed once by a global aggregate; no join and no shuffle of ``df``.
    """
    score = current_value(news, score_col, ts_col, tie_break)
    return df.withColumn(out_col, F.coalesce(score.cast("double"), F.lit(default)))


def points_dim(spark, rows=None) -> DataFrame:
    """The monitored points as a dimension with WKT coordinates."""
    rows = rows or S.DEFAULT_POINTS
    data = [(loc, name, f"POINT({lon} {lat})", "PONTO") for loc, name, lat, lon in rows]
    return spark.createDataFrame(data, S.DIM_GEOGRAFIA)


def map_rows(dim: DataFrame, weather: DataFrame, tie_break: str | Sequence[str],
             loc_col: str = "loc_id", ts_col: str = "timestamp_leitura") -> DataFrame:
    """J1 + E2 + T9 + P13 + T11: one map row per dimension point.

    The weather fact is first reduced to its newest reading per location,
    then the dimension is left-joined to it: same result as joining first and
    ranking after (the key is unique in the dimension) with far less data in
    the join.  A point without readings keeps NULL measures and is drawn
    blue.  The join strategy is left to Spark's size check.  ``tie_break``
    orders readings of one location and time (as the ingest stamp does).
    """
    tie = _as_list(tie_break)
    cols = [loc_col, ts_col, "precipitacao_mm", "velocidade_vento", "alerta_critico"] + \
        [c for c in tie if c not in (loc_col, ts_col, "precipitacao_mm", "velocidade_vento", "alerta_critico")]
    latest = latest_per_key(weather.select(*cols), loc_col, ts_col, tie)
    joined = dim.join(latest, on=loc_col, how="left")
    alert = F.coalesce(F.col("alerta_critico"), F.lit(False))
    na = F.lit(S.MAP_MISSING)
    start, kind, rain, wind, end = (F.lit(x) for x in S.MAP_POPUP)
    popup = F.concat(start, F.coalesce(F.col("nome_ponto"), na), kind, F.coalesce(F.col("tipo_ponto"), na),
                     rain, F.coalesce(F.col("precipitacao_mm").cast("string"), na),
                     wind, F.coalesce(F.col("velocidade_vento").cast("string"), na), end)
    return joined.select(
        loc_col, "nome_ponto",
        point_y(F.col("coordenadas")).alias("lat"),
        point_x(F.col("coordenadas")).alias("lon"),
        "tipo_ponto", "precipitacao_mm", "velocidade_vento", "alerta_critico",
        F.when(alert, F.lit(S.MAP_ALERT_STYLE[0])).otherwise(F.lit(S.MAP_NORMAL_STYLE[0])).alias("color"),
        F.when(alert, F.lit(S.MAP_ALERT_STYLE[1])).otherwise(F.lit(S.MAP_NORMAL_STYLE[1])).alias("icon"),
        popup.alias("popup"),
    )


__all__ = [
    "latest_per_key", "latest_ships", "flag_max", "latest_event", "preview",
    "current_value", "with_current_score", "points_dim", "map_rows",
]
