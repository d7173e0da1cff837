"""M5 for more training rows than the features' bins have cells.

A forest sees a row only through its bins and its class, so rows of one cell of the bins and one
class are alike, and a bag, which holds each row a Poisson(1) number of times, holds n of them a
Poisson(n) number of times.  Spark counts the rows of every cell; tasks then draw the bags of their
trees over the cells and grow them as MLlib does (split by Gini gain, a subset of features a
node, leaves of one prediction merged).  Work and memory beyond the counting follow the cells, at
most bins^features, and not the rows; neither bags nor nodes of rows are kept anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node as MLlib saves it.
NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
         "rawCount bigint, gain double, leftChild int, rightChild int, split struct<featureIndex int, "
         "leftCategoriesOrThreshold array<double>, numCategories int>>")


def bin_of(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` lie below ``x``; NaN lies above all."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))
    return within(0, len(cuts))


def _between(a: float, b: float) -> float:
    """Halfway from ``a`` to the next value ``b``, or ``a`` where no such number parts them."""
    mid = a / 2 + b / 2
    return mid if a <= mid < b and math.isfinite(mid) else a


def plain(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``rows`` as (x0, x1, ..., label): a missing feature is NaN, a label other than 0 and 1 an error."""
    bad = F.raise_error(F.concat(F.lit(f"{label} is neither 0 nor 1: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
    return rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)],
                       F.when(F.col(label).isin(0, 1), F.col(label).cast("int")).otherwise(bad.cast("int")).alias("label"))


def thresholds(rows: DataFrame, features: int, max_bins: int) -> list[list[float]]:
    """For each x of ``rows`` (``plain``) the ascending thresholds that part its values into ``max_bins``
    at most: between all values if there are so few, else between the values at equal shares of all
    rows; missing ones lie above the last.  Only counts and these values reach the driver."""
    x = [F.col(f"x{i}") for i in range(features)]
    shares = [k / max_bins for k in range(1, max_bins)]
    number = lambda c: F.when(~F.isnan(c), c)
    first = rows.agg(*[F.struct(
        F.approx_count_distinct(number(c)).alias("kinds"), F.percentile_approx(number(c), shares, 10_000).alias("at"),
        F.max(number(c)).alias("most"), F.count_if(F.isnan(c)).alias("missing")).alias(f"x{i}") for i, c in enumerate(x)]).first()
    after: list[list[float]] = []  # the values that thresholds follow
    for i, f in enumerate(first):
        at, last = sorted(set(f["at"] or [])), f["most"]
        if f["kinds"] <= 2 * max_bins:  # an estimate: the exact values decide
            few = [r[0] for r in rows.select(number(x[i])).distinct().limit(4 * max_bins).collect() if r[0] is not None]
            if len(few) <= max_bins - (f["missing"] > 0):
                at = sorted(few)
        at = [a for a in at if a < last]
        after.append([*at[:max_bins - 2], last] if f["missing"] and last is not None else at)
    pieces = F.array(*[F.struct(F.lit(i).alias("f"), bin_of(c, after[i]).alias("bin"), number(c).alias("x")) for i, c in enumerate(x)])
    least = {(r["f"], r["bin"]): r["least"] for r in rows.select(F.explode(pieces).alias("p")).groupBy("p.f", "p.bin")
             .agg(F.min("p.x").alias("least")).collect()}  # a row a bin
    return [[a if least.get((i, k + 1)) is None else _between(a, least[i, k + 1]) for k, a in enumerate(at)]
            for i, at in enumerate(after)]


def cells(rows: DataFrame, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Rows of each class in each cell of the bins that ``cuts`` make: (cell, n0, n1)."""
    cell = F.lit(0).cast("bigint")
    for i, at in enumerate(cuts):
        cell = cell * F.lit(len(at) + 1) + bin_of(F.col(f"x{i}"), at)
    return rows.select(cell.alias("cell"), "label").groupBy("cell").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def _impurity(stats: np.ndarray) -> np.ndarray:
    """Gini impurity of class weights in the last axis; 0 of none."""
    total = stats.sum(-1)
    gini = np.ones_like(total)
    for c in range(stats.shape[-1]):  # in MLlib's order, for the same last bits
        share = np.divide(stats[..., c], total, out=np.zeros_like(total), where=total > 0)
        gini -= share * share
    return np.where(total > 0, gini, 0.0)


def grow(bins: np.ndarray, drawn: np.ndarray, widths: Sequence[int], weight: np.ndarray, depth: int, subset: int,
         rng: np.random.Generator) -> list[dict]:
    """One tree over cells: ``bins`` (features x cells), ``drawn`` (classes x cells) rows of its bag.
    Nodes by level: class counts, and for inner ones feature, bin (left at most), gain, left, right."""
    used = drawn.sum(0) > 0
    bins, drawn = bins[:, used], drawn[:, used].astype(float)
    at, front, nodes = np.zeros(drawn.shape[1], np.int64), [0], [{}]
    for level in range(depth + 1):
        n = len(front)
        counts = np.stack([np.bincount(at, d, n) for d in drawn], -1)
        whole = counts * weight
        for k, node in enumerate(front):
            nodes[node]["counts"] = counts[k]
        if level == depth:
            break
        best, feature, split = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        asked = np.zeros((n, len(widths)), bool)
        np.put_along_axis(asked, rng.random((n, len(widths))).argsort(1)[:, :subset], True, 1)
        own = _impurity(whole)
        for f, width in enumerate(widths):
            who = np.flatnonzero(asked[:, f] & (own > 0))
            if width < 2 or not len(who):
                continue
            place = np.full(n, -1)
            place[who] = np.arange(len(who))
            mine = place[at]
            here = np.flatnonzero(mine >= 0)
            key = mine[here] * width + bins[f, here]
            left = np.stack([np.bincount(key, d[here], len(who) * width).reshape(-1, width) for d in drawn], -1).cumsum(1)[:, :-1]
            right = counts[who][:, None] - left
            of = whole[who].sum(-1)[:, None]
            gain = own[who][:, None] - (left * weight).sum(-1) / of * _impurity(left * weight) \
                - (right * weight).sum(-1) / of * _impurity(right * weight)
            gain[(left.sum(-1) < 1) | (right.sum(-1) < 1)] = 0.0
            top = gain.argmax(1)
            more = gain[np.arange(len(who)), top]
            won = more > best[who]
            best[who[won]], feature[who[won]], split[who[won]] = more[won], f, top[won]
        child, new = np.full(n, -1), []
        for k in np.flatnonzero(feature >= 0):
            child[k] = len(new)
            new += [len(nodes), len(nodes) + 1]
            nodes[front[k]] |= {"feature": int(feature[k]), "bin": int(split[k]), "gain": float(best[k]),
                                "left": new[-2], "right": new[-1]}
            nodes += [{}, {}]
        if not new:
            break
        stay = child[at] >= 0
        at, bins, drawn = at[stay], bins[:, stay], drawn[:, stay]
        right = bins[feature[at], np.arange(len(at))] > split[at]
        at, front = child[at] + right, new
    return nodes


def saved(nodes: list[dict], cuts: Sequence[Sequence[float]], weight: np.ndarray, tree: int) -> list[dict]:
    """The nodes as MLlib saves a tree: leaves of one prediction merged, numbered parents first."""
    says = [float(np.argmax(n["counts"] * weight)) for n in nodes]
    for n in reversed(nodes):  # children stand after their parents
        if "left" in n and not any("left" in nodes[n[c]] for c in ("left", "right")) and says[n["left"]] == says[n["right"]]:
            for c in ("feature", "bin", "gain", "left", "right"):
                del n[c]
    out: list[dict] = []

    def put(k: int) -> int:
        n, i = nodes[k], len(out)
        stats = n["counts"] * weight
        out.append(row := {"id": i, "prediction": says[k], "impurity": float(_impurity(stats)), "impurityStats": stats.tolist(),
                           "rawCount": int(n["counts"].sum()), "gain": -1.0, "leftChild": -1, "rightChild": -1,
                           "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}})
        if "left" in n:
            row |= {"gain": n["gain"], "leftChild": put(n["left"]), "rightChild": put(n["right"]), "split": {
                "featureIndex": n["feature"], "leftCategoriesOrThreshold": [float(cuts[n["feature"]][n["bin"]])], "numCategories": -1}}
        return i
    put(0)
    return [{"treeID": tree, "nodeData": n} for n in out]


def fit_nodes(rows: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int, max_bins: int,
              class_weight: bool = False, bootstrap: bool = True, subset: int | None = None) -> DataFrame:
    """The forest's nodes as MLlib saves them (``NODES``), trees grown in tasks of a few each.

    Cells are ordered and a tree draws by seed and number: the same rows give the same forest however
    they are dealt.  The counted cells, at most ``max_bins`` ^ features, are broadcast.
    """
    spark = rows.sparkSession
    rows = plain(rows, features, label)
    cuts = thresholds(rows, len(features), max_bins)
    table = cells(rows, cuts).toArrow().sort_by("cell")  # bounded by the bins
    widths = [len(at) + 1 for at in cuts]
    counts = np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()])
    total = counts.sum(1)
    kinds = np.count_nonzero(total)
    weight = np.array([total.sum() / (kinds * t) if class_weight and t else 1.0 for t in total])
    subset = subset or math.ceil(math.sqrt(len(features)))
    kept = spark.sparkContext.broadcast((np.stack(np.unravel_index(table["cell"].to_numpy(), widths)).astype(np.int16), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, n = kept.value
        for batch in batches:
            for tree in batch["id"].to_pylist():
                rng = np.random.default_rng([seed, tree])
                nodes = grow(bins, rng.poisson(n) if bootstrap else n, widths, weight, depth, subset, rng)
                yield from pa.Table.from_pylist(saved(nodes, cuts, weight, tree), schema=_ARROW).to_batches()
    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, trees, 1, tasks).mapInArrow(run, NODES)


_ARROW = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                         ("numCategories", pa.int32())]))]))])

__all__ = ["fit_nodes", "bin_of", "thresholds", "cells", "grow", "saved", "plain", "NODES"]
