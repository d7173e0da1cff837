"""A forest grown from its rows counted by cell of the bins (M5 beyond as many rows as cells)."""

from __future__ import annotations

import math
import random
from statistics import mean, variance

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.operators import forest, ml

SCHEMA = "k long, " + ", ".join(f"{f} double" for f in S.MODEL_FEATURES) + f", {S.MODEL_LABEL} int"


def few_valued(spark, n=3000):
    """Features of 4 to 30 values each, labels with noise."""
    rng = random.Random(4)
    rows = []
    for k in range(n):
        x = [float(rng.randrange(30)), rng.randrange(7) / 3, float(rng.choice([-2, 0, 1, 9])), rng.randrange(20) * 7.5]
        rows.append((k, *x, int((x[0] > 11) ^ (x[2] == 1) if rng.random() < 0.9 else rng.random() < 0.5)))
    return spark.createDataFrame(rows, SCHEMA)


def synthetic(spark, n=3000):
    return ml.label_features(ml.synth_features(spark.range(n).withColumnRenamed("id", "k"), "k"))


def by_place(nodes):
    return sorted((r.tree, r.node, r.feature, r.rows, r.prediction, r.left, r.right, r.threshold, tuple(r.counts), r.gain)
                  for r in nodes.collect())


@pytest.mark.parametrize("weighted", [False, True])
def test_cells_grow_the_tree_that_mllib_grows_from_rows(spark, scratch, weighted):
    data = few_valued(spark)
    kinds = {r[S.MODEL_LABEL]: r["count"] for r in data.groupBy(S.MODEL_LABEL).count().collect()}
    rf = RandomForestClassifier(labelCol=S.MODEL_LABEL, featuresCol="features", numTrees=1, maxDepth=8, seed=S.SEED,
                                featureSubsetStrategy="all", bootstrap=False)
    wt = F.when(F.col(S.MODEL_LABEL) == 0, 3000 / (2 * kinds[0])).otherwise(3000 / (2 * kinds[1]))
    if weighted:
        rf.setWeightCol("_wt")
    path = ml.save_model(Pipeline(stages=[ml.assembler(), rf]).fit(data.withColumn("_wt", wt)), scratch("rows-tree"))
    at = scratch("cells-tree")
    forest.fit_nodes(data, S.MODEL_FEATURES, S.MODEL_LABEL, 1, 8, S.SEED, 32, weighted, bootstrap=False, subset=4).write.parquet(
        f"{at}/stages/1/data")
    want, got = by_place(ml.forest_nodes(spark, path)), by_place(ml.forest_nodes(spark, at))
    assert len(want) == len(got) > 60
    for a, b in zip(want, got):
        assert a[:4] == b[:4] and a[5:8] == b[5:8]
        assert a[4] == b[4] or a[8][0] == pytest.approx(a[8][1], rel=1e-9)  # weighted classes that tie but for the last bits
        assert a[8] == pytest.approx(b[8], rel=1e-9) and a[9] == pytest.approx(b[9], abs=1e-9)


def test_a_fit_beyond_the_cells_gives_the_same_forest_however_rows_are_dealt(spark, scratch):
    data = synthetic(spark)
    paths = [ml.fit_saved(rows, trees=12, depth=6, max_bins=5, path=scratch(f"dealt-{i}"))  # 625 cells at most
             for i, rows in enumerate((data, data.repartition(7, "wind_feature")))]
    a, b = (by_place(ml.forest_nodes(spark, p)) for p in paths)
    assert a == b and len({r[0] for r in a}) == 12
    model = ml.load_model(paths[0])
    assert model.stages[-1].getNumTrees == 12 and model.stages[-1].getOrDefault("maxBins") == 5
    both = ml.walk(ml.forest_nodes(spark, paths[0]), ml.score(model, data.limit(200)), depth=6).collect()
    assert all(abs(r.risk_probability - r.walk_probability) < 1e-12 and r.prediction == r.walk_prediction for r in both)
    assert all(len(at) <= 4 for at in ml.all_breaks(ml.forest_nodes(spark, paths[0])).values())


def test_bags_over_cells_are_bags_of_rows(spark, scratch):
    data = synthetic(spark)
    path = ml.fit_saved(data, trees=120, depth=7, max_bins=6, path=scratch("bags"))
    drawn = [r.rows for r in ml.forest_nodes(spark, path).filter("node = 0").collect()]
    assert len(drawn) == 120 and abs(mean(drawn) - 3000) < 4 * math.sqrt(3000 / 120)
    assert 0.6 * 3000 < variance(drawn) < 1.5 * 3000  # a row counts Poisson(1) times: cells drawn whole would vary more
    rf = RandomForestClassifier(labelCol=S.MODEL_LABEL, featuresCol="features", numTrees=120, maxDepth=7, seed=S.SEED,
                                maxBins=6, featureSubsetStrategy="sqrt", bootstrap=True)
    rows = Pipeline(stages=[ml.assembler(), rf]).fit(data)
    fresh = synthetic(spark, 4000).filter("k >= 3000")
    a = {r.k: r.risk_probability for r in ml.score(ml.load_model(path), fresh).collect()}
    b = {r.k: r.risk_probability for r in ml.score(rows, fresh).collect()}
    assert mean(abs(a[k] - b[k]) for k in b) < 0.02 and abs(mean(a.values()) - mean(b.values())) < 0.01


def test_thresholds_part_all_rows_evenly_and_missing_ones_lie_above(spark):
    nan = float("nan")
    rows = [(k, float(k), [1.0, 2.0, 4.0][k % 3], nan if k % 4 == 0 else None if k % 4 == 1 else float(k), 5.0, k % 2) for k in range(1000)]
    x = forest.plain(spark.createDataFrame(rows, SCHEMA), S.MODEL_FEATURES, S.MODEL_LABEL)
    even, few, missing, one = forest.thresholds(x, 4, 8)
    assert len(even) == 7 and all(abs(t - (k + 1) * 125) <= 2 and t % 1 == 0.5 for k, t in enumerate(even))
    assert few == [1.5, 3.0] and one == []
    assert len(missing) <= 7 and missing == sorted(missing) and missing[-1] == 999.0  # parts the numbers from the missing
    kept = forest.cells(x, [even, few, missing, one]).collect()
    assert sum(r.n0 for r in kept) == sum(r.n1 for r in kept) == 500
    of = lambda r: (r.cell // len([0, *missing])) % 3  # noqa: E731  the second feature's bin
    assert sorted({of(r) for r in kept}) == [0, 1, 2]
    gone = sum(r.n0 + r.n1 for r in kept if r.cell % (len(missing) + 1) == len(missing))
    assert gone == 500


def test_numbers_that_nothing_parts_and_empty_features_do_no_harm(spark, scratch):
    inf, tiny = float("inf"), 5e-324
    rows = [(k, [-inf, 0.0, inf][k % 3], [0.0, tiny][k % 2], None, 1.5, int(k % 3 == 2)) for k in range(900)]
    data = spark.createDataFrame(rows, SCHEMA)
    at = forest.thresholds(forest.plain(data, S.MODEL_FEATURES, S.MODEL_LABEL), 4, 4)
    assert at == [[-inf, 0.0], [0.0], [], []]
    path = ml.fit_saved(data, trees=5, depth=4, max_bins=4, path=scratch("odd"))  # 900 rows, 256 cells
    out = ml.walk(ml.forest_nodes(spark, path), ml.score(ml.load_model(path), data), depth=4).collect()
    assert all(abs(r.walk_probability - r.risk_probability) < 1e-12 for r in out)
    assert mean(r.prediction == r[S.MODEL_LABEL] for r in out) > 0.99


def test_labels_of_one_class_and_labels_that_are_none(spark, scratch):
    data = synthetic(spark, 900).withColumn(S.MODEL_LABEL, F.lit(0))
    path = ml.fit_saved(data, trees=3, depth=3, max_bins=4, path=scratch("one-class"))
    assert [(r.rows > 0, r.left, r.prediction, r.counts[1]) for r in ml.forest_nodes(spark, path).collect()] == [(True, -1, 0.0, 0.0)] * 3
    with pytest.raises(Exception, match="neither 0 nor 1"):
        ml.fit_saved(data.withColumn(S.MODEL_LABEL, F.when(F.col("k") > 5, 1)), trees=3, depth=3, max_bins=4, path=scratch("no-label"))


@pytest.fixture(scope="module")
def model_and_nodes(spark):
    from portrisk.session import scratch_path
    path = ml.fit_saved(synthetic(spark), trees=15, depth=6, path=scratch_path(spark, "sweep-forest"))
    return ml.load_model(path), ml.forest_nodes(spark, path)


def test_a_sweep_with_nodes_shares_scorings_and_equals_the_plain_one(spark, model_and_nodes, monkeypatch):
    model, nodes = model_and_nodes
    nan = float("nan")
    odd = [(k, *[[None, nan, 5.0, 1e9][(k // 4 ** f) % 4] for f in range(4)], 0) for k in range(256)]
    base = synthetic(spark, 200).select(*S.MODEL_FEATURES).union(spark.createDataFrame(odd, SCHEMA).select(*S.MODEL_FEATURES))
    want = {r.value: r for r in ml.sweep(model, base, "wind_feature").collect()}
    scored, score = [], ml.score
    monkeypatch.setattr(ml, "score", lambda m, df: scored.append(df.count()) or score(m, df))
    many = base.crossJoin(spark.range(30).select(F.col("id").alias("copy"))).drop("copy")
    ml.sweep(model, base, "wind_feature", nodes=nodes).collect()
    got = ml.sweep(model, many, "wind_feature", nodes=nodes)
    assert got.columns == ["value", "mean_probability", "min_probability", "max_probability", "rows"]
    got = {r.value: r for r in got.collect()}
    assert scored[0] == scored[1] < 456 * len(S.SWEEP_WIND_VALUES)  # thirty times the rows, as many scorings
    assert got.keys() == want.keys() and len(got) == len(S.SWEEP_WIND_VALUES)
    for v, r in want.items():
        assert got[v].rows == 30 * r.rows == 30 * 456
        assert all(abs(got[v][c] - r[c]) < 1e-12 for c in ("mean_probability", "min_probability", "max_probability"))


def test_sensitivity_sweep_scores_cells_and_not_ships(spark, model_and_nodes, monkeypatch):
    from portrisk.plans import catalog
    from tests.conftest import SF_SMALL
    model, nodes = model_and_nodes
    monkeypatch.setattr(catalog, "trained_model", lambda *a: model)
    monkeypatch.setattr(catalog, "model_path", lambda *a: "")
    monkeypatch.setattr(ml, "forest_nodes", lambda *a: nodes)
    base = catalog._fleet(spark, SF_SMALL).select(*S.MODEL_FEATURES)
    want = {r.value: r for r in ml.sweep(model, base, "wind_feature").collect()}
    swept, sweeps = [], ml.sweeps
    monkeypatch.setattr(ml, "sweeps", lambda *a: swept.append(a) or sweeps(*a))
    got = {r.value: r for r in catalog.q_sensitivity_sweep(spark, SF_SMALL).collect()}
    assert len(swept) == 1 and got.keys() == want.keys()
    assert all(g.rows == want[v].rows and abs(g.mean_probability - want[v].mean_probability) < 1e-12 for v, g in got.items())


def test_the_walk_takes_rows_down_arrays_and_not_down_lambdas(spark, model_and_nodes):
    model, nodes = model_and_nodes
    rows = synthetic(spark, 500)
    plan = ml.walk(nodes, rows, depth=6)._jdf.queryExecution().toString()
    assert "lambda" not in plan and "EvalPython" in plan
    deep = ml.walk(nodes, ml.score(model, rows), depth=9).collect()  # deeper than the trees: leaves stay where they are
    assert len(deep) == 500
    assert all(abs(r.risk_probability - r.walk_probability) < 1e-12 and r.prediction == r.walk_prediction for r in deep)
