"""Quality scores by a byte-level convolutional network written in numpy.

Learned filters run over every byte of a text.  Their activations are averaged over
overlapping chunks that cover the whole text; a second bank of learned filters reads each
chunk's averages, its answers are max-pooled over all chunks, and one logistic unit combines
them into a probability.  A filter over four bytes is a sum of table look-ups, so the first
layer is a gather for each byte, and texts of any length are read in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import in_training, prepare, sample_ids, texts_of

#: Bytes under a filter, filters of each layer, bytes between chunks (a chunk is twice that).
WIDTH, FILTERS, HIDDEN, HOP = 4, 12, 8, 128
#: Bounds of the training sample: rows of each label, UTF-8 bytes of a text.
MAX_LABELLED, MAX_BYTES = 1500, 1 << 18
THRESHOLD = 0.5
#: Bytes of a text that are read at a time (a multiple of HOP).
PIECE = HOP << 13


@dataclass
class Net:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    lift: np.ndarray  # (FILTERS,)
    usual: np.ndarray  # (FILTERS,) mean of a chunk's averages, fixed before training
    spread: np.ndarray  # (FILTERS,) and their deviation
    chunk: np.ndarray  # (2 * FILTERS, HIDDEN)
    chunk_lift: np.ndarray  # (HIDDEN,)
    out: np.ndarray  # (HIDDEN,)
    bias: np.ndarray  # ()


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


class Reader:
    """Scores texts with a fitted net."""

    def __init__(self, net: Net) -> None:
        self.net = net
        # two neighbouring bytes index one row: half as many gathers
        self._first = (net.taps[0][:, None] + net.taps[1][None]).reshape(65536, FILTERS) + net.lift
        self._second = (net.taps[2][:, None] + net.taps[3][None]).reshape(65536, FILTERS)

    def sums(self, b: np.ndarray, n: int) -> np.ndarray:
        """Sums of the first layer's activations over each hop of the first ``n`` bytes of ``b``.

        ``b`` goes on past ``n`` by the width of a filter where the text does.
        """
        wide = np.concatenate([b, np.zeros(max(0, n + WIDTH - 1 - len(b)), np.uint8)])
        pair = wide[:-1].astype(np.int32) << 8 | wide[1:]
        act = self._first.take(pair[:n], axis=0)
        act += self._second.take(pair[2:n + 2], axis=0)
        np.maximum(act, 0, out=act)
        return np.add.reduceat(act, np.arange(0, n, HOP), axis=0)

    def averages(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean activations (chunks, FILTERS) of the overlapping chunks of a whole text, and
        each chunk's share of a full chunk's bytes (0 for the one chunk of an empty text)."""
        n = len(b)
        if n == 0:
            return np.zeros((1, FILTERS), np.float32), np.zeros(1, np.float32)
        hops = np.concatenate([self.sums(b[at:at + PIECE + WIDTH - 1], min(PIECE, n - at)) for at in range(0, n, PIECE)])
        return chunk_means(hops, n)

    def score(self, text: str | None) -> float:
        x = inputs(self.net, *self.averages(as_bytes(text)))
        z = second(self.net, x).max(axis=0) @ self.net.out + self.net.bias
        return 1.0 / (1.0 + math.exp(-min(max(float(z), -60.0), 60.0)))


def chunk_means(hops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means over chunks of two hops, each overlapping the next; a text of one hop is one chunk."""
    size = np.full(len(hops), HOP, np.float32)
    size[-1] = n - HOP * (len(hops) - 1)
    if len(hops) > 1:
        hops, size = hops[:-1] + hops[1:], size[:-1] + size[1:]
    return hops / size[:, None], size / (2 * HOP)


def inputs(net: Net, means: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What the second bank reads of each chunk: standardised averages and their squares.

    Averages over fewer bytes vary more, so a short chunk's count as less unusual.
    """
    x = (means - net.usual) / net.spread * np.sqrt(share)[:, None]
    return np.concatenate([x, x * x], axis=1)


def second(net: Net, x: np.ndarray) -> np.ndarray:
    """Answers of the second filter bank to the inputs of each chunk."""
    return np.maximum(x @ net.chunk + net.chunk_lift, 0)


def _gradients(net: Net, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the logistic loss; through the max-pool only the deciding chunks matter."""
    reader = Reader(net)
    read = [reader.averages(b) for b in texts]
    x = [inputs(net, *r) for r in read]
    h = [second(net, i) for i in x]
    best = np.stack([k.argmax(axis=0) for k in h])  # (texts, HIDDEN)
    top = np.stack([k.max(axis=0) for k in h])
    p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -30, 30)))
    dz = (p - labels) / len(labels)
    dh = dz[:, None] * net.out * (top > 0)
    got = {"out": top.T @ dz, "bias": dz.sum(), "chunk_lift": dh.sum(axis=0),
           "chunk": np.zeros_like(net.chunk), "lift": np.zeros_like(net.lift), "taps": np.zeros_like(net.taps)}
    rows, slopes = [], []
    for t, b in enumerate(texts):
        for c in np.unique(best[t]):
            d = np.where(best[t] == c, dh[t], 0)
            got["chunk"] += np.outer(x[t][c], d)
            di = net.chunk @ d
            dm = (di[:FILTERS] + 2 * x[t][c, :FILTERS] * di[FILTERS:]) / net.spread * math.sqrt(read[t][1][c])
            part = b[c * HOP:(c + 2) * HOP + WIDTH - 1]
            n = min(2 * HOP, len(b) - c * HOP)
            if n <= 0 or not dm.any():
                continue
            part = np.concatenate([part, np.zeros(max(0, n + WIDTH - 1 - len(part)), np.uint8)])
            rows.append(np.stack([part[j:j + n] for j in range(WIDTH)]))
            slopes.append(np.broadcast_to(dm / n, (n, FILTERS)))
    if rows:
        seen, slope = np.concatenate(rows, axis=1), np.concatenate(slopes)
        act = sum(net.taps[j][seen[j]] for j in range(WIDTH)) + net.lift
        slope = slope * (act > 0)
        got["lift"] = slope.sum(axis=0)
        for j in range(WIDTH):
            at = seen[j].astype(np.intp)[:, None] * FILTERS + np.arange(FILTERS)
            got["taps"][j] = np.bincount(at.ravel(), slope.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return got


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.02,
          seed: int = 6) -> Net:
    """A net fitted to whole texts (byte arrays) and their 0/1 labels with Adam.

    Without texts of both labels every text scores the share of label 1 (0.5 without any).
    """
    rng = np.random.default_rng(seed)
    f32 = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Net(f32(WIDTH, 256, FILTERS) * 0.5, np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32),
              np.ones(FILTERS, np.float32), f32(2 * FILTERS, HIDDEN) * 0.2, np.full(HIDDEN, -0.5, np.float32),
              f32(HIDDEN) * 0.3, np.float32(0))
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 0.001, 0.999)) if len(labels) else 0.5
        net.out, net.bias = np.zeros(HIDDEN, np.float32), np.float32(math.log(share / (1 - share)))
        return net
    reader = Reader(net)
    some = np.concatenate([reader.averages(texts[i])[0] for i in rng.permutation(len(texts))[:200]])
    net.usual, net.spread = some.mean(axis=0), some.std(axis=0) + 1e-3
    m: dict[str, np.ndarray] = {}
    v: dict[str, np.ndarray] = {}
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            use = order[at:at + batch]
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for name, g in _gradients(net, [texts[i] for i in use], labels[use]).items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                move = pace * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-7)
                setattr(net, name, np.asarray(getattr(net, name) - move, np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> Net:
    """A net from whole texts of the training folds: at most ``max_labelled`` rows of each label,
    chosen by a hash of the id, of which texts over ``max_bytes`` are not learnt from.

    One task trains on the sample and returns the net alone.  Rows without id and labels that
    are null teach nothing, null texts count as empty, rows that repeat an id are all learnt
    from, an id labelled both ways counts as label 0; without texts of both labels every text
    scores the share of label 1 (0.5 without labels or documents).
    """
    prepare(docs.sparkSession)
    known = labels.filter(in_training(id_col) & F.col(label_col).isNotNull())
    low = sample_ids(known.filter(F.col(label_col) == 0), max_labelled, id_col)
    high = sample_ids(known.filter(F.col(label_col) == 1), max_labelled, id_col)
    label = {i: 1 for i in high} | {i: 0 for i in low}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known_as = [], []
        for b in batches:
            known_as += [label[i] for i in b.column(0).to_pylist()]
            texts += [as_bytes(t) for t in b.column(1).to_pylist()]
        net = train(texts, np.array(known_as))
        parts = [(f.name, np.asarray(getattr(net, f.name), np.float32)) for f in fields(Net)]
        yield pa.record_batch([pa.array([name for name, _ in parts]), pa.array([x.tobytes() for _, x in parts], pa.binary()),
                               pa.array([list(x.shape) for _, x in parts], pa.list_(pa.int32()))],
                              names=["name", "data", "shape"])
    found = texts_of(docs, set(label), id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    trained = (found.filter(F.octet_length("text") <= max_bytes).repartition(1).sortWithinPartitions("id", "text")
               .mapInArrow(learn, "name string, data binary, shape array<int>"))
    got = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]).copy() for r in trained.collect()}
    return Net(**got) if got else train([], np.array([]))  # no documents, so no task


def scored(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``; null text counts as empty.

    Every byte of a text is read; ids pass through, null or repeated; an empty table gives an
    empty table; only the text is an input of the score.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for b in batches:
            got = [reader.score(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(got, pa.float64()),
                                   pa.array([int(x >= threshold) for x in got], pa.int32())],
                                  names=["id", "score", "predicted"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, score double, predicted int")
