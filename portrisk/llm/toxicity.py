"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled ones, never confirmed clean ones.  With
the share of toxic texts (the class prior) known, the risk on clean texts is the risk on
unlabelled ones minus the toxic part of it; that estimate is held at zero or above, so that
a batch cannot fit it below.  A text scores as its most toxic
word: a word's score is linear over hashed features (itself and its beginnings), of those
whose share among toxic texts is clearly above their share among unlabelled ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import in_training, per_batch, prepare, sample_ids, texts_of

DIMS = 1 << 18
#: Word beginnings that are features beside the word, in bytes.
BEGINNINGS = (4, 5, 6)
#: Bounds of the training sample: confirmed toxic texts and unlabelled texts.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 10_000
THRESHOLD = 0.7
#: Words whose weight a worker keeps at hand.
KEEP = 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """Distinct words of the whole text: lower case, split at anything but letters and digits."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LOWER).split())


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    return [zlib.crc32(word) % DIMS, *(zlib.crc32(word[:n], n) % DIMS for n in BEGINNINGS if len(word) > n)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the distinct words of a text, and the number of features of each word."""
    of = [word_features(w) for w in sorted(words(text))]
    return np.array([f for ids in of for f in ids], np.int32), np.array([len(ids) for ids in of], np.int32)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_z: float = 5.0) -> np.ndarray:
    """Ids of the features whose shares of the two sets of texts differ by ``least_z`` deviations."""
    n, k = len(positive), len(unlabelled)
    p, u = (np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=DIMS) for rows in (positive, unlabelled))
    share = (p + u + 1.0) / (n + k + 2.0)
    z = (p / n - u / k) / np.sqrt(share * (1 - share) * (1 / n + 1 / k))
    return np.nonzero(z >= least_z)[0]


@dataclass
class Model:
    weights: dict[int, float]  # by feature
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        """Score of a text in 0..1; word scores are kept between texts."""
        known: dict[bytes, float] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            if len(known) >= KEEP:
                known.clear()
            top = 0.0
            for w in words(text):
                z = known.get(w)
                if z is None:
                    z = known[w] = sum([weights.get(f, 0.0) for f in word_features(w)])
                if z > top:
                    top = z
            z = bias + top
            return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))
        return score


Row = tuple[np.ndarray, np.ndarray]


def margin(w: np.ndarray, rows: list[Row], shown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts under the weights ``w`` (bias last) by those of their words that are
    ``shown``, and the features (with their texts) of the words that decide them."""
    ids, sizes = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    ids = ids[np.repeat(shown, sizes)]
    text = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])[shown]
    sizes = sizes[shown]
    word = np.repeat(np.arange(len(sizes)), sizes)
    value = np.bincount(word, w[ids], len(sizes)).astype(float)
    order = np.lexsort((value, text))
    last = np.nonzero(np.append(np.diff(text) > 0, True))[0] if len(text) else np.zeros(0, np.int64)
    best = order[last]
    best = best[value[best] > -1.0]  # a word below zero still learns while it is near
    z = np.zeros(len(rows))
    z[text[best]] = np.maximum(value[best], 0.0)
    decides = np.isin(word, best)
    return z + w[-1], ids[decides], text[word[decides]]


def gradient(w: np.ndarray, positive: list[Row], unlabelled: list[Row], prior: float,
             shown: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """Non-negative risk of the sigmoid loss, and its slope by weight (bias last).

    The risk is that of missed toxic texts plus that of clean ones, which is the unlabelled
    texts' less its toxic part; where that is below zero it counts as zero and does not pull.
    """
    p, u = margin(w, positive, shown[0]), margin(w, unlabelled, shown[1])
    sp, su = 1 / (1 + np.exp(-p[0])), 1 / (1 + np.exp(-u[0]))

    def slope(at: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray) -> np.ndarray:
        # counts of no ids come as integers, whatever their weights
        g = np.bincount(at[1], d[at[2]], len(w)).astype(float)
        g[-1] = d.sum()
        return g
    clean_risk = su.mean() - prior * sp.mean()
    toward_toxic = slope(p, prior * sp * (1 - sp) / len(sp))
    g = -toward_toxic
    if clean_risk > 0:
        g = g + slope(u, su * (1 - su) / len(su)) - toward_toxic
    return prior * (1 - sp).mean() + max(clean_risk, 0.0), g


def train(positive: list[Row], unlabelled: list[Row], prior: float, epochs: int = 80, batch: int = 256,
          rate: float = 0.05, decay: float = 1e-5, drop: float = 0.3, seed: int = 3) -> Model:
    """Non-negative PU learning with the sigmoid loss and Adam; texts as ``features`` gives them.

    Each step hides a share ``drop`` of the words, so that no word learns only beside others.
    Without positive or unlabelled texts, with a prior of 0, or when no feature tells them
    apart (few or empty toxic texts, toxic texts with the words of all others), every text
    scores the prior.
    """
    prior = float(np.clip(prior, 0.0, 0.999))
    start = float(np.log(max(prior, 1e-6) / (1 - prior)))
    if not positive or not unlabelled or prior <= 0:
        return Model({}, start)
    use = telling([r[0] for r in positive], [r[0] for r in unlabelled])
    if not len(use):
        return Model({}, start)
    place = np.full(DIMS, -1, np.int64)
    place[use] = np.arange(len(use))

    def kept(row: Row) -> Row:
        x = place[row[0]]
        word = np.repeat(np.arange(len(row[1])), row[1])[x >= 0]
        return x[x >= 0], np.unique(word, return_counts=True)[1]

    positive, unlabelled = [kept(r) for r in positive], [kept(r) for r in unlabelled]
    n = len(use)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = start
    rng, step = np.random.default_rng(seed), 0

    def shown(rows: list[Row]) -> np.ndarray:
        return rng.random(sum(len(r[1]) for r in rows)) >= drop

    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u = [unlabelled[i] for i in order[at:at + batch]]
            hidden_u = shown(u)
            p = [positive[i] for i in rng.integers(0, len(positive), min(batch, len(positive)))]
            _, g = gradient(w, p, u, prior, (shown(p), hidden_u))
            g[:n] += decay * w[:n]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model({int(f): float(x) for f, x in zip(use, w)}, float(w[n]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from the confirmed toxic rows of ``labels`` and unlabelled ``docs``, training folds only.

    Both are samples by a hash of the id, at most ``max_positive`` and ``max_unlabelled`` texts;
    the class prior is the toxic share of all training labels.  Features are taken where the
    texts lie; one task trains on the sample's features and returns the weights alone.  Rows
    without id and labels that are null teach nothing, null texts count as empty, of rows with
    one id the text with the smallest SHA-256 is learnt from, an id labelled twice counts
    toxic if one of its labels does; without labels or documents every text scores the prior.
    """
    prepare(docs.sparkSession)
    known = labels.filter(in_training(id_col) & F.col(label_col).isNotNull())
    prior = known.agg(F.avg((F.col(label_col) == 1).cast("double")).alias("p")).first()["p"] or 0.0
    toxic = sample_ids(known.filter(F.col(label_col) == 1), max_positive, id_col)
    other = sample_ids(docs.filter(in_training(id_col)), max_unlabelled, id_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [features(t) for t in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                                pa.array([g[1] for g in got], pa.list_(pa.int32()))],
                               names=["id", "mark", "ids", "sizes"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, Row] = {}
        for b in batches:
            for k, i in enumerate(b.column(0).to_pylist()):
                if i not in rows:
                    rows[i] = (b.column(1)[k].values.to_numpy().copy(), b.column(2)[k].values.to_numpy().copy())
        model = train([rows[i] for i in toxic if i in rows], [rows[i] for i in other if i in rows], prior)
        yield pa.record_batch([pa.array([-1, *model.weights], pa.int32()),
                               pa.array([model.bias, *model.weights.values()], pa.float64())], names=["f", "w"])
    texts = texts_of(docs, {*toxic, *other}, id_col, text_col).withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = per_batch(texts, run, "id long, mark string, ids array<int>, sizes array<int>")
    trained = (found.repartition(1).sortWithinPartitions("id", "mark").select("id", "ids", "sizes")
               .mapInArrow(learn, "f int, w double"))
    weights = {r["f"]: r["w"] for r in trained.collect()}
    if not weights:  # no documents, so no task
        return train([], [], prior)
    return Model({f: w for f, w in weights.items() if f >= 0}, weights[-1])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``; null text counts as empty.

    Empty texts score as texts without any telling word; ids pass through, null or repeated;
    an empty table gives an empty table; only the text is an input of the score.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            got = [score(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(got, pa.float64()),
                                   pa.array([int(x >= threshold) for x in got], pa.int32())],
                                  names=["id", "score", "predicted"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged, in one pass."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
