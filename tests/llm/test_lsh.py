import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from portrisk.llm import lsh
from portrisk.llm.queries import QUERIES


def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        score = (v * v[ids.tolist().index(q)]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r[2], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(0).normal(size=(50, 48))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = lsh.signed_axes(x, 3)
    assert turned.shape == (50, 128) and np.allclose(turned[:, :64] @ turned[:, :64].T, u @ u.T)
    assert np.allclose(lsh.signed_axes(x * 7, 3), turned) and not np.allclose(lsh.signed_axes(x, 4), turned)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    e = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, v = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy()).astype(float)
    want = brute(ids, v, [i for i in ids if i % 20 == 0], 20)
    got = answers(QUERIES["op2_cross_polytope"](spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.92
    for q, found in got.items():
        assert [x for x in found] == sorted(found, key=lambda x: (-x[1], x[0]))
        true = v[[ids.tolist().index(i) for i, _ in found[:3]]] @ v[ids.tolist().index(q)]
        assert np.allclose(true, [s for _, s in found[:3]], atol=1e-12)


def test_hot_vectors_ties_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(lsh, "CHUNK", 64)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype(np.float32)
    v = [hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32) for i in range(600)]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(5)
    got = answers(lsh.search(df, F.col("id") % 60 == 0, k=5, tables=4, probes=16))
    want = brute(np.arange(600), np.stack(v).astype(float), range(0, 600, 60), 5)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    one = answers(lsh.search(df.filter("vec_id < 4"), F.col("id") == 0, k=20, tables=1, probes=1))
    assert {i for i, _ in one[0]} == {1, 2, 3}  # all there are, by the exact way


@pytest.mark.parametrize("axes, widths", [(32, (64,)), (1, (64,)), (7, (3, 64, 100))])
def test_groups_of_axes_lose_and_repeat_nothing(spark, monkeypatch, axes, widths):
    """However axes are grouped, a query meets each row of the axes it probes once a table."""
    monkeypatch.setattr(lsh, "AXES", axes)
    rng = np.random.default_rng(5)
    v = [rng.normal(size=widths[i % len(widths)]).tolist() for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>").repartition(3)
    index = lsh.placed(rows.select("v", F.array("id").alias("ids")), 3, 1)
    queries = lsh.probing(rows.filter("id % 20 = 0"), None, 3, 1)
    left, right = (x.toPandas() for x in lsh.dealt(index, queries))
    assert len(left) == 3 * 400 and not left.grp.isna().any()
    assert (left.grp == left.axis // axes).all() and not right.duplicated(["id", "tab", "grp"]).any()
    got = left.merge(right, on=["width", "tab", "grp"])
    got = got[[a in p for a, p in zip(got.axis, got.probed)]]
    a, b = index.toPandas(), queries.toPandas()
    want = sorted((q, int(i[0]), t) for q, p, w in zip(b.id, b.probed, b.width) for i, x, d in zip(a.ids, a.axis, a.width)
                  for t in range(3) if d == w and x[t] in p[t])
    assert sorted(zip(got.id, got.ids.str[0], got.tab)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (1, [0.0, 1.0]), (9, [2.0, 0.0]), (9, [-2.0, 0.0]), (40, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, v int")
    got = answers(lsh.search(df, F.col("id") % 20 == 0, k=3))
    assert got == {0: [(20, 0.5), (1, 0.0), (9, -2.0)], 20: [(0, 0.5), (1, 0.5), (9, -1.0)]}
    assert lsh.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def drawn(n, width, kind, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "log-normal":
        v *= np.exp(rng.normal(size=(n, 1)) * 0.5)
    if kind == "some long":
        v[rng.random(n) < 0.01] *= 5
    return v


@pytest.mark.parametrize("n, width", [(2000, 64), (2000, 128), (2000, 384), (20000, 64), (20000, 128), (20000, 384)])
@pytest.mark.parametrize("kind", ["equal", "log-normal", "some long"])
def test_recall_of_probed_buckets(n, width, kind):
    """Buckets that a query probes hold 0.9 of its 20 nearest, whatever the width and lengths."""
    v, asked = drawn(n, width, kind), np.arange(40)
    score = v[asked] @ v.T
    score[asked, asked] = -np.inf
    top = np.argpartition(-score, 20, axis=1)[:, :20]
    seen = np.zeros((len(asked), n), bool)
    for t in range(lsh.TABLES):
        near = lsh.signed_axes(v, t)
        probed = np.zeros((len(asked), near.shape[1]), bool)
        best = np.argsort(-near[asked], axis=1)[:, :lsh.default_probes(near.shape[1])]
        probed[asked[:, None], best] = True
        seen |= probed[:, near.argmax(axis=1)]
    assert np.take_along_axis(seen, top, axis=1).mean() >= 0.9 and seen.mean() < 0.85


@pytest.mark.parametrize("width, kind", [(100, "log-normal"), (384, "some long")])
def test_recall_of_search_on_wide_and_unequal_vectors(spark, width, kind):
    v = drawn(2000, width, kind, 3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = answers(lsh.search(rows, F.col("id") % 50 == 0, k=20))
    assert recall(got, brute(np.arange(2000), v, range(0, 2000, 50), 20)) >= 0.9


def test_wider_vectors_probe_more_axes():
    assert [lsh.default_probes(2 * w) for w in (2, 64, 128, 512)] == [1, 16, 43, 205]
