"""Best-fit packing of token sequences by patterns fitted to the length histogram.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches the
driver.  There, patterns of a few lengths that fill a sequence exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded, and
what remains is packed best-fit, longest first, whole counts at a time.  The plan says which
range of pieces of each length goes to which sequences; in Spark each piece finds its place
by its rank among all pieces ordered by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.bpe import byte_bpe
from portrisk.llm.common import per_batch, prepare, stored
from portrisk.llm.running import running

LIMIT = 1024
END_ID = 2
#: Lengths in a fitted pattern; longer sequences come from packing what is left.
DEPTH = 3
ROUNDS = 200


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first takes the remainder."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def pieces(docs: DataFrame, bpe_path: str, ranks_path: str | None = None, limit: int = LIMIT,
           end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc) of every piece of every row; null text counts as empty.

    A document is its token ids and ``end_id``; only one longer than ``limit`` is cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(bpe_path, ranks_path)
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1).to_pylist()):
                tokens = np.append(bpe.encode(t or ""), np.uint32(end_id)).astype("<u4")
                out += [(i, k, s, n, zlib.crc32(tokens[s:s + n].tobytes()))
                        for k, (s, n) in enumerate(cuts(len(tokens), limit))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                   *(pa.array(c, pa.int64()) for c in cols[2:])],
                                  names=["id", "piece", "start", "length", "crc"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, piece int, start long, length long, crc long")


def exact_patterns(lengths: np.ndarray, limit: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` (at most 3) of ``lengths``, descending, 0 for none, that sum to ``limit``."""
    have = np.zeros(limit + 1, bool)
    have[lengths] = True
    found = [np.array([[limit, 0, 0]])] if have[limit] else []
    if depth >= 2:
        a = lengths[2 * lengths >= limit]
        a = a[(a < limit) & have[limit - a]]
        found.append(np.stack([a, limit - a, 0 * a], 1))
    if depth >= 3:
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        c = limit - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        ok = have[c]
        found.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x that minimise the squared tokens left in the histogram.

    Accelerated projected gradient on sparse columns: each pattern touches few lengths.
    """
    limit = len(counts) - 1
    scale = float(counts.sum()) or 1.0
    weight = np.arange(limit + 1) / limit  # a length's share of a sequence
    weight[0] = 0.0
    target = counts / scale * weight
    slots = [np.ascontiguousarray(c, np.intp) for c in patterns.T]
    apply = lambda x: sum(np.bincount(c, x, limit + 1) for c in slots) * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r.take(c) for c in slots)

    probe = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue
        probe = back(apply(probe))
        top = np.linalg.norm(probe)
        probe /= top or 1.0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(apply(y) - target) / (1.02 * top or 1.0))
        if np.dot(y - new, new - x) > 0:  # overshoot: start the momentum anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that pack ``counts`` best-fit, longest first, equal bins together."""
    limit = len(counts) - 1
    room: list[list[list]] = [[] for _ in range(limit + 1)]  # by space left: [pattern, repeats]
    for n in range(limit, 0, -1):
        left, space = int(counts[n]), n
        while left:
            while space <= limit and not room[space]:
                space += 1
            if space > limit:
                pattern, bins = (), -(-left // (limit // n))
                space = limit
            else:
                pattern, bins = room[space].pop()
            times = min(space // n, left)
            full = min(bins, left // times)
            rest = bins - full
            room[space - times * n].append([(*pattern, *(n,) * times), full])
            left -= full * times
            if rest and left and left < times:  # the last bin takes what is left
                room[space - left * n].append([(*pattern, *(n,) * left), 1])
                rest, left = rest - 1, 0
            if rest and pattern:
                room[space].append([pattern, rest])
            space = n
    return [(p, k) for groups in room for p, k in groups if k]


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram once.  counts[n]: pieces of n tokens."""
    limit = len(counts) - 1
    left = np.array(counts, np.int64)
    patterns = exact_patterns(np.nonzero(left)[0], limit, depth)
    out = []
    if len(patterns):
        x = fit(patterns, left)
        for k in np.argsort(-x, kind="stable"):
            want = int(np.rint(x[k]))
            if want <= 0:
                break
            use, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = int(min(want, (left[use] // times).min()))
            if n > 0:
                left[use] -= n * times
                out.append((tuple(int(v) for v in patterns[k] if v), n))
    return out + best_fit(left)


def places(counts: np.ndarray, packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(from_place, sequence, offset) of every slot of the plan, by place.

    Pieces are placed in order of length; a slot takes as many successive pieces as its
    pattern repeats, the first to ``sequence``, the next to the sequence after it.
    """
    cursor = np.concatenate([[0], np.cumsum(counts)[:-1]])
    slots, sequence = [], 0
    for pattern, n in packed:
        at = 0
        for length in pattern:
            slots.append((cursor[length], sequence, at))
            cursor[length] += n
            at += length
        sequence += n
    slots.sort()
    return tuple(np.array(c, np.int64) for c in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 3


def pack(cut: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """``cut`` (rows of ``pieces``) with sequence_id and offset: where each piece goes.

    Every row gets one place, repeated rows too; a sequence holds ``limit`` tokens at most and
    is filled from 0 without gaps.  An empty table gives an empty table.
    """
    hist = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # limit rows at most
    counts = np.zeros(limit + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["n"]
    begin, sequence, offset = places(counts, plan(counts, depth))
    placed = running(cut, [F.col(c).asc_nulls_first() for c in ("length", "id", "piece", "start", "crc")],
                     {"place": F.lit(1)}, "pieces-placed")
    names = [c for c in cut.columns]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        place = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
        k = np.searchsorted(begin, place, "right") - 1
        return pa.record_batch([*b.columns[:-1], pa.array(sequence[k] + place - begin[k]), pa.array(offset[k])],
                               names=[*names, "sequence_id", "offset"])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return per_batch(placed.select(*names, "place"), run, f"{types}, sequence_id long, offset long")


def packed(docs: DataFrame, bpe_path: str, ranks_path: str | None = None, limit: int = LIMIT,
           end_id: int = END_ID, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all ``docs`` with their places: (id, piece, start, length, crc, sequence_id, offset).

    Null text counts as empty (one piece of one token); null and repeated ids are packed row by
    row; other columns are ignored; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    return pack(stored(pieces(docs, bpe_path, ranks_path, limit, end_id, id_col, text_col), "pieces"), limit, depth)
