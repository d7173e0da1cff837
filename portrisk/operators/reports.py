"""Dashboard and EDA aggregates.

Every report is a partial + final aggregate: only aggregated rows cross the
network and only the report reaches the driver.  Global scalars (totals,
maxima, bounds) are scalar subqueries, never keyless windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import nan_to_null, news_tier
from ..session import scratch_path


def fleet_kpis(ships: DataFrame, rain_col: str = "rain_feature",
               nlp_col: str = "nlp_risk_score", ts_col: str = "inserido_em") -> DataFrame:
    """A1: ship count, mean rain (NULLs skipped), mean news score x100, newest stamp.

    The original labels the last KPI as a model probability; it is the mean
    news score, so it is named for what it is.
    """
    return ships.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_ships"),
        F.avg(nan_to_null(rain_col)).alias("mean_rain_mm"),
        (F.avg(nan_to_null(nlp_col)) * F.lit(100.0)).alias("mean_nlp_risk_pct"),
        F.max(ts_col).alias("last_update"),
    )


def access_risk(news: DataFrame, score_col: str = "score_risco",
                ts_col: str = "timestamp_leitura", tie_break: str = "cont_id") -> DataFrame:
    """A2 + P12: newest score x100 (0 when there is no row) and its tier.

    A global aggregate always yields one row, also for an empty table.
    """
    ordering = F.struct(F.col(ts_col), F.col(tie_break))
    row = news.agg(F.max_by(F.col(score_col), ordering).alias("score"),
                   F.max_by(F.col("texto_original"), ordering).alias("texto_original")
                   if "texto_original" in news.columns else F.lit(None).cast("string").alias("texto_original"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    return row.select((score * F.lit(100.0)).alias("access_risk_pct"),
                      news_tier(score).alias("tier"), "texto_original")


def volume_by_terminal(ships: DataFrame, terminal_col: str = "terminal",
                       qty_col: str = "quantidade_estimada", rain_col: str = "rain_feature") -> DataFrame:
    """A3: tonnage per terminal (bar length), mean rain (colour), ship count."""
    return ships.groupBy(terminal_col).agg(
        F.sum(nan_to_null(qty_col)).alias("total_volume"),
        F.avg(nan_to_null(rain_col)).alias("mean_rain_mm"),
        F.count(F.lit(1)).cast("bigint").alias("n_ships"))


def rain_segments(ships: DataFrame, terminal_col: str = "terminal",
                  qty_col: str = "quantidade_estimada", rain_col: str = "rain_feature") -> DataFrame:
    """A3: the stacked bar itself, tonnage of each (terminal, rain) segment."""
    return ships.groupBy(terminal_col, nan_to_null(rain_col).alias(rain_col)).agg(
        F.sum(nan_to_null(qty_col)).alias("volume"), F.count(F.lit(1)).cast("bigint").alias("n_ships"))


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """A4/O2: counts of non-null values, most frequent first (ties by value), top ``k``."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    ordered = counts.orderBy(F.col("count").desc(), F.col(col).asc())
    if k is None:
        return ordered
    # the top-k itself is the report; rank is kept so the order survives a compare
    return ordered.limit(k).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col(col).asc())).cast("int"))


def arrivals_by_date(lineup: DataFrame, date_col: str = "data_chegada_prevista") -> DataFrame:
    """Arrivals per date, ascending date (NULL dates dropped, as value_counts does)."""
    d = F.to_date(F.col(date_col))
    return (lineup.filter(F.col(date_col).isNotNull())
            .groupBy(d.alias(date_col)).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy(date_col))


def class_share(df: DataFrame, label_col: str) -> DataFrame:
    """Share of each label value (normalised value counts)."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


# ---------------------------------------------------------------------------
# A7 describe
# ---------------------------------------------------------------------------

def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(measure, x) rows for the given columns; NaN and NULL dropped (pandas rule)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"),
                 F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x"))
        for c in cols])).alias("p")
    return df.select(pairs).select("p.*").filter(F.col("x").isNotNull())


def _ranked_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(measure, x, c, lo, hi, n): distinct values with their counts and the ranks [lo, hi)
    they hold among the n values of their measure.

    Distinct values are range-partitioned and written with their range's number; a range gets
    its offset from the totals of the ranges before it (ranges x measures rows), so no task
    sees all values and there is no global sort.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "quantiles")
    (_long(df, cols).groupBy("measure", "x").agg(F.count(F.lit(1)).alias("c"))
     .repartitionByRange("measure", "x").withColumn("pid", F.spark_partition_id()).write.parquet(path))
    ranged = spark.read.parquet(path)
    per_part = ranged.groupBy("measure", "pid").agg(F.sum("c").alias("pc"))
    of = Window.partitionBy("measure")
    before = of.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("measure", "pid", F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("off"),
                              F.sum("pc").over(of).alias("n"))
    local = Window.partitionBy("pid", "measure").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("upto", F.sum("c").over(local)).join(offsets, ["measure", "pid"])
            .withColumn("hi", F.col("off") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("c")))


def _quantile_cells(cum: DataFrame, probs: Sequence[float]) -> list[Column]:
    """One aggregate per probability: linear interpolation between the two ranks around it."""
    out = []
    for p in probs:
        pos = (F.col("n") - 1) * F.lit(float(p))
        at = lambda r: F.max(F.when((r >= F.col("lo")) & (r < F.col("hi")), F.col("x")))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        out.append(low + (high - low) * share)
    return out


def exact_quantiles(df: DataFrame, cols: str | Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns: ``(measure, prob, value)``.

    One job lays out the distinct values, one aggregate reads all quantiles from their ranks.
    """
    cum = _ranked_values(df, [cols] if isinstance(cols, str) else list(cols))
    cells = cum.groupBy("measure").agg(*[c.alias(f"q{i}") for i, c in enumerate(_quantile_cells(cum, probs))])
    return cells.select("measure", F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col(f"q{i}").alias("value")) for i, p in enumerate(probs)])).alias("q")
    ).select("measure", "q.prob", "q.value")


def describe_columns(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Pandas ``describe()`` in long form ``(measure, stat, value)``.

    count, mean, std (sample), min, 25%, 50%, 75% (exact, linear), max; NaN counts as
    missing, as in pandas.  All from one table of distinct values with counts and ranks: one
    job that lays it out and one aggregate over it.
    """
    cum = _ranked_values(df, cols)
    x, c = F.col("x"), F.col("c").cast("double")
    mean = F.sum(x * c) / F.sum(c)
    first = cum.groupBy("measure").agg(
        F.sum(c).alias("count"), mean.alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        *[q.alias(s) for q, s in zip(_quantile_cells(cum, [0.25, 0.5, 0.75]), ("25%", "50%", "75%"))])
    centred = (cum.join(first.select("measure", F.col("mean").alias("centre")), "measure")  # a row per column
               .groupBy("measure").agg(F.sqrt(F.sum((x - F.col("centre")) ** 2 * c) / F.nullif(F.sum(c) - 1, F.lit(0.0))).alias("std")))
    wide = first.join(centred, "measure", "right")
    stats = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
    every = df.sparkSession.createDataFrame([(m,) for m in cols], "measure string")
    out = every.join(wide, "measure", "left").select("measure", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"),
                 (F.coalesce(F.col("count"), F.lit(0.0)) if s == "count" else F.col(f"`{s}`")).alias("value"))
        for s in stats])).alias("s")).select("measure", "s.*")
    return out.withColumn("value", F.round("value", digits)) if digits is not None else out


# ---------------------------------------------------------------------------
# A8 histogram, A9 kernel density
# ---------------------------------------------------------------------------

def _bounds(df: DataFrame, col: str, lo: float | None, hi: float | None):
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    lo_c = F.lit(float(lo)) if lo is not None else df.select(F.min(v)).scalar()
    hi_c = F.lit(float(hi)) if hi is not None else df.select(F.max(v)).scalar()
    return v, lo_c, hi_c


def auto_bins(df: DataFrame, col: str) -> int:
    """The plotting library's automatic number of bins for whole data: the finer of the
    Freedman-Diaconis and the Sturges width over the range; at least 1."""
    v = nan_to_null(col)
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if not s["n"] or s["hi"] == s["lo"]:
        return 1
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, col, [0.25, 0.75]).collect()}  # two rows
    width = (s["hi"] - s["lo"]) / (math.log2(s["n"]) + 1)
    fine = 2 * (q[0.75] - q[0.25]) / s["n"] ** (1 / 3)
    return math.ceil((s["hi"] - s["lo"]) / (min(width, fine) if fine > 0 else width))


def histogram(df: DataFrame, col: str, bins: int | None = None, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins over [lo, hi] (data min/max by default); the last
    bin is closed on the right.  Every bin is returned, empty ones with 0.
    Without ``bins`` their number is ``auto_bins``.  Output ``(bin, bin_lo, bin_hi, count)``.
    """
    bins = auto_bins(df, col) if bins is None else bins
    v, lo_c, hi_c = _bounds(df, col, lo, hi)
    width = (hi_c - lo_c) / F.lit(float(bins))
    b = F.least(F.floor((F.col("v") - lo_c) / width), F.lit(bins - 1)).cast("int")
    counts = (df.select(v.alias("v")).filter(F.col("v").isNotNull()
                                              & (F.col("v") >= lo_c) & (F.col("v") <= hi_c))
              .select(F.when(width > 0, b).otherwise(F.lit(0)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo_c + F.col("bin") * width).alias("bin_lo"),
                    (lo_c + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0).cast("bigint")).alias("count")))


#: A kernel further away than this many bandwidths adds less than rounding does.
KDE_REACH = 9.0


def kde(df: DataFrame, col: str, grid_size: int = 200, bandwidth: float | None = None,
        cut: float = 0.0) -> DataFrame:
    """Exact Gaussian kernel density on a grid: ``(i, x, density)``.

    Bandwidth defaults to Scott's rule (n^-1/5 x sample std); the grid spans
    [min - cut*h, max + cut*h], by default the data's range, as a histogram's curve is drawn.
    Equal readings are counted first; every different one adds to the grid points within
    ``KDE_REACH`` bandwidths, summed before the shuffle.
    """
    v = nan_to_null(col)
    counts = df.select(v.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n = s["n"]
    h = float(bandwidth) if bandwidth is not None else (s["sd"] or 0.0) * n ** -0.2 if n else 0.0
    grid = df.sparkSession.range(grid_size).select(F.col("id").cast("int").alias("i"))
    if not n or not h > 0:
        return grid.filter("false").select("i", F.lit(0.0).alias("x"), F.lit(0.0).alias("density"))
    start, end = s["lo"] - cut * h, s["hi"] + cut * h
    step = (end - start) / (grid_size - 1)
    at = lambda side: F.floor((F.col("v") + F.lit(side * KDE_REACH * h) - F.lit(start)) / F.lit(step))
    first = F.greatest(at(-1.0), F.lit(0)).cast("int")
    last = F.least(at(1.0) + 1, F.lit(grid_size - 1)).cast("int")
    reach = F.when(first <= last, F.sequence(first, last))
    near = counts.select("v", "c", F.explode(reach).alias("i"))
    weight = F.col("c") * F.exp(F.lit(-0.5) * F.pow((F.lit(start) + F.col("i") * F.lit(step) - F.col("v")) / F.lit(h), 2))
    sums = near.groupBy("i").agg(F.sum(weight).alias("w"))
    return (grid.join(sums, "i", "left")
            .select("i", (F.lit(start) + F.col("i") * F.lit(step)).alias("x"),
                    (F.coalesce("w", F.lit(0.0)) / F.lit(n * h * math.sqrt(2.0 * math.pi))).alias("density")))


# ---------------------------------------------------------------------------
# A10 confusion matrix, A11 classification report
# ---------------------------------------------------------------------------

def _cells(pred: DataFrame, label_col: str, pred_col: str, classes: Sequence[int]) -> DataFrame:
    aggs = [F.count_if((F.col(label_col) == F.lit(a)) & (F.col(pred_col) == F.lit(p)))
            .cast("bigint").alias(f"c_{a}_{p}") for a in classes for p in classes]
    return pred.agg(*aggs)


def confusion_matrix(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """A10: one row per (label, prediction) cell, zero cells included; one pass."""
    cells = _cells(pred, label_col, pred_col, classes)
    return cells.select(F.explode(F.array(*[
        F.struct(F.lit(a).cast("int").alias("label"), F.lit(p).cast("int").alias("prediction"),
                 F.col(f"c_{a}_{p}").alias("count"))
        for a in classes for p in classes])).alias("s")).select("s.*")


def classification_report(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                          classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1, support per class; accuracy; macro and
    weighted averages.  A zero denominator gives 0, as the original's default.
    Output ``(row_label, precision, recall, f1_score, support)``.
    """
    cells = _cells(pred, label_col, pred_col, classes)

    def c(a, p):
        return F.col(f"c_{a}_{p}").cast("double")

    def safe_div(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    rows, prec, rec, f1, sup = [], {}, {}, {}, {}
    total = sum((c(a, p) for a in classes for p in classes), F.lit(0.0))
    for k in classes:
        tp = c(k, k)
        pred_k = sum((c(a, k) for a in classes), F.lit(0.0))
        true_k = sum((c(k, p) for p in classes), F.lit(0.0))
        prec[k] = safe_div(tp, pred_k)
        rec[k] = safe_div(tp, true_k)
        f1[k] = safe_div(F.lit(2.0) * prec[k] * rec[k], prec[k] + rec[k])
        sup[k] = true_k
        rows.append(F.struct(F.lit(str(k)).alias("row_label"), prec[k].alias("precision"),
                             rec[k].alias("recall"), f1[k].alias("f1_score"),
                             true_k.cast("bigint").alias("support")))
    acc = safe_div(sum((c(k, k) for k in classes), F.lit(0.0)), total)
    rows.append(F.struct(F.lit("accuracy").alias("row_label"),
                         F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"),
                         acc.alias("f1_score"), total.cast("bigint").alias("support")))
    m = float(len(classes))
    rows.append(F.struct(
        F.lit("macro avg").alias("row_label"),
        (sum((prec[k] for k in classes), F.lit(0.0)) / F.lit(m)).alias("precision"),
        (sum((rec[k] for k in classes), F.lit(0.0)) / F.lit(m)).alias("recall"),
        (sum((f1[k] for k in classes), F.lit(0.0)) / F.lit(m)).alias("f1_score"),
        total.cast("bigint").alias("support")))
    rows.append(F.struct(
        F.lit("weighted avg").alias("row_label"),
        safe_div(sum((prec[k] * sup[k] for k in classes), F.lit(0.0)), total).alias("precision"),
        safe_div(sum((rec[k] * sup[k] for k in classes), F.lit(0.0)), total).alias("recall"),
        safe_div(sum((f1[k] * sup[k] for k in classes), F.lit(0.0)), total).alias("f1_score"),
        total.cast("bigint").alias("support")))
    return cells.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


__all__ = [
    "fleet_kpis", "access_risk", "volume_by_terminal", "value_counts", "arrivals_by_date",
    "class_share", "exact_quantiles", "describe_columns", "histogram", "kde",
    "confusion_matrix", "classification_report", "rain_segments",
]
