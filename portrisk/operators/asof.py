"""As-of join (J2): each left row with the newest right row at or before its time.

Left times are first reduced to the distinct ones of each key, so a whole batch with one
insert stamp is one row.  These and the right rows are laid out in ranges of (key, time) and
written with their range's number.  Inside a range a window carries the last right row
forward; what a key had before its range comes from one summary row per range and key.  A
key that holds a third of all rows, or the only key of a one-port feed, is thus spread over
ranges, whatever its times look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


class AsOfSide:
    """One right side of an as-of join: frame, time column, columns to carry
    (``{source: output}``) and the tie-break for rows sharing a time."""

    def __init__(self, df: DataFrame, ts: str, cols: Sequence[str] | dict[str, str],
                 tie: Sequence[str] = ()):
        self.df = df
        self.ts = ts
        self.cols = dict(cols) if isinstance(cols, dict) else {c: c for c in cols}
        self.tie = list(tie)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              right_cols: Sequence[str] | dict[str, str], right_tie: Sequence[str] = ()) -> DataFrame:
    """Left rows + the as-of right columns (renamed by ``right_cols`` if a dict).

    ``right_tie`` orders right rows that share a time (the last one wins).
    Right rows with a NULL key or time can never match and are dropped.
    """
    return asof_join_many(left, by, left_ts, [AsOfSide(right, right_ts, right_cols, right_tie)])


def asof_join_many(left: DataFrame, by: Sequence[str], left_ts: str, sides: Sequence[AsOfSide]) -> DataFrame:
    """J2 against several right sides in one pass: each side's newest row as of the left
    time is carried in its own struct column."""
    by, n = list(by), len(sides)
    keys = [f"_k{i}" for i in range(len(by))]
    rights = []
    for i, sd in enumerate(sides):
        r = sd.df.filter(F.col(sd.ts).isNotNull())
        for k in by:
            r = r.filter(F.col(k).isNotNull())
        rights.append(r.select(*[F.col(k).alias(a) for k, a in zip(by, keys)],
                               F.col(sd.ts).cast("timestamp").alias("_t"), F.lit(0).alias("_side"),
                               F.struct(*[F.col(c) for c in sd.tie] or [F.lit(0).alias("_")]).alias(f"_tie{i}"),
                               F.struct(F.struct(*[F.col(c).alias(o) for c, o in sd.cols.items()]).alias("p")).alias(f"_w{i}")))
    kinds = {c: r.schema[c].dataType for i, r in enumerate(rights) for c in (f"_tie{i}", f"_w{i}")}
    asked = left.select(*[F.col(k).alias(a) for k, a in zip(by, keys)], F.col(left_ts).cast("timestamp").alias("_t"))
    asked = asked.na.drop().distinct().withColumn("_side", F.lit(1))
    whole = None
    for part in [*rights, asked]:
        part = part.select(*keys, "_t", "_side", *[
            F.col(c) if c in part.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
        whole = part if whole is None else whole.unionByName(part)
    order = ["_t", "_side", *[f"_tie{i}" for i in range(n)]]
    path = scratch_path(left.sparkSession, "asof")
    whole.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    laid = left.sparkSession.read.parquet(path)

    # what each range leaves behind for a key, and what it finds from the ranges before it
    ends = laid.groupBy("_range", *keys).agg(*[
        F.max_by(f"_w{i}", F.when(F.col(f"_w{i}").isNotNull(), F.struct("_t", f"_tie{i}"))).alias(f"_end{i}") for i in range(n)])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"{k}_") for k in keys],
                          *[F.last(f"_end{i}", ignorenulls=True).over(earlier).alias(f"_from{i}") for i in range(n)])
    so_far = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = (laid.select("_range", *keys, "_t", "_side",
                        *[F.last(f"_w{i}", ignorenulls=True).over(so_far).alias(f"_m{i}") for i in range(n)])
            .filter("_side = 1"))
    on = [F.col("_range") == F.col("_r"), *[F.col(k) == F.col(f"{k}_") for k in keys]]
    answers = seen.join(carried, on).select(
        *[F.col(k).alias(f"{k}_of") for k in keys], F.col("_t").alias("_t_of"),
        *[F.coalesce(f"_m{i}", f"_from{i}").alias(f"_a{i}") for i in range(n)])
    same = [F.col(left_ts).cast("timestamp") == F.col("_t_of"), *[F.col(k) == F.col(f"{a}_of") for k, a in zip(by, keys)]]
    return left.join(answers, same, "left").select(*left.columns, *[
        F.col(f"_a{i}.p.{out}").alias(out) for i, sd in enumerate(sides) for out in sd.cols.values()])


def feature_store(lineup: DataFrame, weather: DataFrame, news: DataFrame, port_loc: str,
                  ts_col: str = "inserido_em", weather_tie: Sequence[str] = ("inserido_em",),
                  news_tie: Sequence[str] = ("cont_id",)) -> DataFrame:
    """J2 definition of the feature-store view (the original's view is not shipped).

    Line-up rows + the weather at ``port_loc`` as of the insert time
    (``rain_feature``, ``wind_feature``) + the news score as of the insert
    time (``nlp_risk_score``; no news yet -> 0.0, the scorer's default).
    """
    w = weather.filter(F.col("loc_id") == F.lit(port_loc))
    tie = [c for c in weather_tie if c in w.columns]
    sides = [AsOfSide(w, "timestamp_leitura",
                      {"precipitacao_mm": "rain_feature", "velocidade_vento": "wind_feature"}, tie),
             AsOfSide(news, "timestamp_leitura", {"score_risco": "nlp_risk_score"}, news_tie)]
    out = asof_join_many(lineup, [], ts_col, sides)
    return out.withColumn("nlp_risk_score", F.coalesce("nlp_risk_score", F.lit(0.0)))


__all__ = ["AsOfSide", "asof_join", "asof_join_many", "feature_store"]
