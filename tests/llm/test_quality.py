import zlib

import numpy as np
import pandas as pd
import pytest

from portrisk.llm import quality
from portrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def small_net():
    rng = np.random.default_rng(0)
    texts = [quality.as_bytes("".join(rng.choice(list("abcdefgh   ."), int(rng.integers(1, 900))))) for _ in range(120)]
    labels = rng.integers(0, 2, 120)
    texts = [t if y else quality.as_bytes(bytes(t).decode().replace(" ", "## ")) for t, y in zip(texts, labels)]
    return texts, labels, quality.train(texts, labels, epochs=2)


def test_held_out_accuracy(spark):
    got = QUERIES["op6_quality"](spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    x = got[got.held_out].merge(labels, on="doc_id")
    assert x[x.quality == 1].predicted.mean() > 0.99 and x[x.quality == 0].predicted.mean() < 0.06


def test_layers_equal_plain_loops(small_net):
    texts, _, net = small_net
    for b in [*texts[:12], quality.as_bytes("x"), quality.as_bytes("ab" * 400)]:
        padded = np.concatenate([b, np.zeros(quality.WIDTH, np.uint8)])
        act = np.array([np.maximum(sum(net.taps[j][padded[i + j]] for j in range(quality.WIDTH)) + net.lift, 0)
                        for i in range(len(b))])
        starts = range(0, max(1, len(b) - quality.HOP), quality.HOP)
        want = np.array([act[s:s + 2 * quality.HOP].mean(axis=0) for s in starts])
        means, share = quality.Reader(net).averages(b)
        assert np.allclose(means, want, atol=1e-3) and (share > 0).all() and (share <= 1).all()


def test_pieces_of_a_long_text_read_as_one(small_net, monkeypatch):
    _, _, net = small_net
    b = quality.as_bytes("long text ## with ends. " * 900)
    whole = quality.Reader(net).averages(b)[0]
    monkeypatch.setattr(quality, "PIECE", quality.HOP * 3)
    assert np.allclose(quality.Reader(net).averages(b)[0], whole, atol=1e-4)


def test_gradients_equal_differences(small_net):
    texts, labels, net = small_net
    use, y = texts[:6], labels[:6].astype(np.float64)

    def loss():
        z = np.array([quality.second(net, quality.inputs(net, *quality.Reader(net).averages(b))).max(axis=0) @ net.out
                      + net.bias for b in use])
        return float(np.mean(np.logaddexp(0, z) - y * z))
    for name in ("taps", "lift", "chunk", "chunk_lift", "out", "bias"):
        value = np.asarray(getattr(net, name), np.float64)
        setattr(net, name, value)
    g = quality._gradients(net, use, y)
    for name in ("lift", "chunk", "chunk_lift", "out"):
        value = getattr(net, name)
        k = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        value[k] += 1e-4
        up = loss()
        value[k] -= 2e-4
        down = loss()
        value[k] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][k]) < 0.03 * abs(g[name][k]) + 1e-4


def test_odd_rows(spark, small_net):
    net = small_net[2]
    rows = [(1, None, 1), (2, "", 1), (None, "abc", 1), (3, "##", 1), (3, "##", 1), (4, "long words " * 100000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    got = quality.scored(docs, net).collect()
    assert sorted(str(r["id"]) for r in got) == ["1", "2", "3", "3", "4", "None"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["id"] in (1, 2)}) == 1 and quality.scored(docs.limit(0), net).count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, quality.fit(docs, labels)).filter("score = 0.5").count() == len(rows)


def test_fit_trains_on_bounded_whole_texts(spark, small_net):
    texts, labels, _ = small_net
    rows = [(3 * i + k, bytes(t).decode()) for i, t in enumerate(texts) for k in range(3)]
    docs = spark.createDataFrame([*rows, (1000, "## " * 200), (1001, None)], "doc_id long, text string").repartition(4)
    marks = [(i, int(labels[i // 3])) for i, _ in rows] + [(1000, 1), (1000, 0), (1001, 1)]
    known = spark.createDataFrame(marks, "doc_id long, quality int")
    training = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    for most in (quality.MAX_BYTES, 300):
        want = sorted((i, t or "") for i, t in [*rows, (1000, "## " * 200), (1001, "")]
                      if training(i) and len((t or "").encode()) <= most)
        label = dict(marks) | {1000: 0}
        net = quality.train([quality.as_bytes(t) for _, t in want], np.array([label[i] for i, _ in want]))
        got = quality.fit(docs, known, max_bytes=most)
        for name in ("taps", "lift", "usual", "spread", "chunk", "chunk_lift", "out", "bias"):
            a, b = getattr(got, name), getattr(net, name)
            assert a.shape == np.shape(b) and np.allclose(a, b, atol=1e-6), name
    one = quality.fit(docs.limit(0), known)
    assert quality.Reader(one).score("x") == 0.5
