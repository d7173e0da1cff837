import random
import zlib

import numpy as np
import pandas as pd

from portrisk.llm import toxicity
from portrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op3_toxicity"](spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    x = got[got.held_out].merge(labels, on="doc_id")
    assert x[x.toxic == 1].predicted.mean() > 0.65 and x[x.toxic == 0].predicted.mean() < 0.01


def made(n, seed, share=0.2):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(1 + len(text) // 50):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "grobianus", "Grobianer!", "nastyish"])
        rows.append((" ".join(text), toxic))
    return rows


def test_learns_from_positive_and_unlabelled_texts_only():
    rows, fresh = made(3000, 1), made(1500, 2)
    positive = [toxicity.features(t) for t, y in rows if y][:200]
    unlabelled = [toxicity.features(t) for t, _ in rows]
    score = toxicity.train(positive, unlabelled, 0.2).scorer()
    said = np.array([score(t) >= 0.7 for t, _ in fresh])
    truth = np.array([y for _, y in fresh])
    assert said[truth].mean() > 0.95 and said[~truth].mean() < 0.01
    assert score("plain " * 100000 + "GROBIANISM") >= 0.7  # by its beginning, and at any length


def test_no_positives_or_no_texts():
    model = toxicity.train([], [toxicity.features("a b")], 0.0)
    assert 0 <= model.scorer()(None) <= 1 and model.scorer()("") == model.scorer()(None)


def test_odd_rows(spark):
    model = toxicity.Model({f: 4.0 for f in toxicity.word_features(b"grobian")}, -3.0)
    rows = [(1, None, 9.0), (2, "", 9.0), (None, "a grobian", 9.0), (3, "GROBIAN###", 9.0), (3, "GROBIAN###", 9.0),
            (4, "long " * 200000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    got = sorted((str(r["id"]), r["predicted"]) for r in toxicity.scored(docs, model).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("4", 0), ("None", 1)]
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    empty = toxicity.fit(docs.limit(0), labels)
    assert toxicity.accepted(docs, empty).count() == len(rows)


def test_few_empty_or_untelling_toxic_texts(spark):
    words = "one two three four five six seven".split()
    docs = spark.createDataFrame([(i, " ".join(words[i % 7:] + words)) for i in range(60)], "doc_id long, text string")
    for toxic in (2, 7):
        labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(60)], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        said = toxicity.scored(docs, model).collect()
        assert len({r["score"] for r in said}) == 1 and len(said) == 60
    empty = docs.withColumn("text", toxicity.F.when(toxicity.F.col("doc_id") < 20, "").otherwise(toxicity.F.col("text")))
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    for data in (empty, docs):  # toxic texts without words, and with the words of all others
        assert toxicity.accepted(data, toxicity.fit(data, labels)).count() == 60


def test_one_of_repeated_ids_is_learnt_whatever_the_order(spark):
    rows = made(900, 5)
    data = [(i // 2, t) for i, (t, _) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, int(y)) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    one = toxicity.fit(docs.repartition(1), labels)
    assert one == toxicity.fit(docs.repartition(5), labels) and one.weights


def brute_score(text, model):
    """Most toxic word of the text by its own features."""
    best = 0.0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text.lower())
    for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" "):
        raw = w.encode()
        ids = [zlib.crc32(raw) % toxicity.DIMS] + [zlib.crc32(raw[:n], n) % toxicity.DIMS for n in (4, 5, 6) if len(raw) > n]
        best = max(best, sum(model.weights.get(f, 0.0) for f in ids) if w else 0.0)
    return 1 / (1 + np.exp(-(model.bias + best)))


def test_scorer_against_brute_force():
    rows = made(600, 8)
    model = toxicity.train([toxicity.features(t) for t, y in rows if y], [toxicity.features(t) for t, _ in rows], 0.2)
    score = model.scorer()
    for t, _ in [*made(200, 9), ("", 0), ("Ünnamed VILEST; vilest", 0), ("123 nastyishly", 0)]:
        assert abs(score(t) - brute_score(t, model)) < 1e-12


def brute_risk(w, positive, unlabelled, prior):
    def z(row):
        at, best = 0, 0.0
        for size in row[1]:
            best = max(best, sum(w[f] for f in row[0][at:at + size]))
            at += size
        return best + w[-1]
    sp = [1 / (1 + np.exp(-z(r))) for r in positive]
    su = [1 / (1 + np.exp(-z(r))) for r in unlabelled]
    return prior * np.mean([1 - s for s in sp]) + max(0.0, np.mean(su) - prior * np.mean(sp))


def test_training_step_against_differences():
    rng = np.random.default_rng(4)
    for case, prior in enumerate((0.2, 0.2, 0.9)):
        def row():
            sizes = rng.integers(1, 4, rng.integers(0, 5))
            return rng.integers(0, 12, int(sizes.sum())), sizes
        positive, unlabelled = [row() for _ in range(6)], [row() for _ in range(20)]
        if case == 1:  # a step without telling words: only the bias learns
            positive, unlabelled = [(r[0][:0], r[1][:0]) for r in positive], [(r[0][:0], r[1][:0]) for r in unlabelled]
        w = np.append(rng.uniform(0.1, 2.0, 12), -1.0)
        shown = tuple(np.ones(sum(len(r[1]) for r in rows), bool) for rows in (positive, unlabelled))
        risk, g = toxicity.gradient(w, positive, unlabelled, prior, shown)
        assert abs(risk - brute_risk(w, positive, unlabelled, prior)) < 1e-12 and g.dtype == float
        for k in range(13):
            step = np.zeros(13)
            step[k] = 1e-6
            want = (brute_risk(w + step, positive, unlabelled, prior) - brute_risk(w - step, positive, unlabelled, prior)) / 2e-6
            assert abs(g[k] - want) < 1e-7
        assert g[-1] != 0
