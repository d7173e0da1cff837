"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints come from word shingles, one pass over the texts.  Distinct fingerprints are
dealt into tiles by population count.  Two fingerprints within ``radius`` bits have
population counts that differ by ``radius`` at most, so only such tile pairs are formed;
inside a pair, blocks whose population counts of 16-bit quarters rule a match out are
skipped too, and the rest is compared exactly (numpy exclusive-or and bit count).  A tile
pair emits a spanning forest of its links, never all pairs; components follow in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import drop_rows, keyed, per_batch, prepare, stored
from portrisk.llm.components import connected_components

BITS = 64
#: Most fingerprints in a tile (2 MB of them).
TILE = 1 << 18
#: Most tasks for the comparison of tile pairs.
MAX_TASKS = 2000
_ROWS, _COLS = 256, 1024
_LANES = np.uint64(0x0101010101010101)
_SHIFT = [np.uint64(k) for k in range(8)]


def shingle_hashes(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of ``text``, A-Z lower-cased, repeats included.

    Words are runs of anything but ASCII white space.  Fewer words than ``shingle`` give
    the hash of the whole sequence; no word gives an empty array.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space after each word
    starts = [0, *ends[:len(ends) - shingle]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:])),
                       np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of ``hashes``; 0 for none."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 8), np.int64)  # [bit within byte, byte]
    whole = n - n % 255
    for k in range(8):
        lanes = (hashes >> _SHIFT[k]) & _LANES  # eight byte-wide counters in each word
        parts = [lanes[whole:].sum(dtype=np.uint64)]
        if whole:
            parts = np.append(lanes[:whole].reshape(-1, 255).sum(axis=1, dtype=np.uint64), parts)
        counts[k] = np.asarray(parts, "<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).T.reshape(-1)  # byte 0's bits first
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row of ``docs``; null text counts as empty."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, shingle, seed)) if t else 0 for t in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                               names=["id", "fp"])
    return per_batch(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")),
                     run, "id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest quarter counts of each block of ``step`` fingerprints."""
    q, at = _quarters(x), np.arange(0, len(x), step)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (u, v) of the links between two tiles, or inside one (right None)."""
    order = lambda x: x[np.lexsort(_quarters(x).T[::-1])]  # noqa: E731  tight blocks
    a = order(left)
    b, shift = (a, 0) if right is None else (order(right), len(a))
    nodes = a if right is None else np.concatenate([a, b])
    parent = np.arange(len(nodes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(a) and len(b):
        (alo, ahi), (blo, bhi) = _blocks(a, _ROWS), _blocks(b, _COLS)
        xor, dist = np.empty((_ROWS, _COLS), np.uint64), np.empty((_ROWS, _COLS), np.uint8)
        for i in range(len(alo)):
            rows = a[i * _ROWS:(i + 1) * _ROWS]
            gap = np.maximum(np.maximum(alo[i] - bhi, blo - ahi[i]), 0).sum(axis=1)
            for j in np.nonzero(gap <= radius)[0]:
                if right is None and (j + 1) * _COLS <= i * _ROWS:
                    continue  # compared the other way round
                cols = b[j * _COLS:(j + 1) * _COLS]
                x, d = xor[:len(rows), :len(cols)], dist[:len(rows), :len(cols)]
                np.bitwise_xor(rows[:, None], cols[None, :], out=x)
                np.bitwise_count(x, out=d)
                near = d <= radius
                if right is None and not near.sum() > np.count_nonzero(x == 0) or not near.any():
                    continue
                r0, c0 = i * _ROWS, shift + j * _COLS
                while True:  # link across components until the block has no such link
                    hit_r, hit_c = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
                    lr = np.full(len(rows), -1)
                    lc = np.full(len(cols), -2)
                    lr[hit_r] = [find(r0 + r) for r in hit_r]
                    lc[hit_c] = [find(c0 + c) for c in hit_c]
                    near &= lr[:, None] != lc[None, :]
                    if not near.any():
                        break
                    some_r, some_c = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
                    for r, c in [*zip(some_r, near[some_r].argmax(axis=1)),
                                 *zip(near[:, some_c].argmax(axis=0), some_c)]:
                        p, q = find(r0 + r), find(c0 + c)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
    child = (parent != np.arange(len(nodes))).nonzero()[0]
    return nodes[child], nodes[[find(i) for i in child]] if len(child) else nodes[:0]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fps`` (fp long) within ``radius``.

    The number of fingerprints per population count (65 values at most) goes to the driver
    and fixes the tiles.  Work is one exact comparison for each tile pair not ruled out.
    """
    pop = F.bit_count("fp")
    sizes = {r["p"]: r["n"] for r in fps.groupBy(pop.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = [-(-sizes.get(p, 0) // tile) for p in range(BITS + 1)]
    base = [0, *accumulate(chunks)]
    first = [base[max(p - radius, 0)] for p in range(BITS + 1)]
    last = [base[min(p + radius, BITS) + 1] - 1 for p in range(BITS + 1)]
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), pop + 1)
    own = at(base[:-1]) + F.pmod(F.xxhash64("fp"), at([max(c, 1) for c in chunks])).cast("int")
    dealt = (fps.select("fp", own.alias("own"), F.explode(F.sequence(at(first), at(last))).alias("other"))
             .select("fp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        fp, own_, a, b = g["fp"].to_numpy().view(np.uint64), g["own"].to_numpy(), g["a"].iloc[0], g["b"].iloc[0]
        u, v = link_tiles(fp[own_ == a], None if a == b else fp[own_ == b], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    # tasks by number of tile pairs, not by their bytes: the work is in comparing
    pairs = sum(hi - lo + 1 for n, lo, hi in zip(chunks, first, last) for _ in range(n))
    dealt = dealt.repartition(max(1, min(pairs, MAX_TASKS)), "a", "b")
    return dealt.groupBy("a", "b").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: (id, fp long, component_id).

    Rows link when their fingerprints differ in ``radius`` bits or fewer; component_id is the
    smallest id reachable (null ids are never it unless all are null).  Null and empty texts
    have fingerprint 0 and link like any other; repeated rows come out as often as they come
    in; an empty table gives an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    each = stored(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    fps = stored(each.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fp")
    roots = stored(connected_components(links(fps.select("fp"), radius, tile)), "roots")
    linked = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # both tables are as long as the fingerprints: joined by shuffle whatever their size now
    names = stored(linked.join(ids.hint("shuffle_hash"), "root").select(F.col("fp").alias("of"), "component_id"), "names")
    return each.join(names.hint("shuffle_hash"), F.col("fp") == F.col("of")).select("id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42,
                            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that with the smallest id
    (of rows that share it, and of rows without one, the first)."""
    prepare(docs.sparkSession)
    rows, key = keyed(docs, id_col)
    found = stored(near_duplicates(rows, shingle, radius, seed, key, text_col), "components")
    if key == id_col:
        gone = found.filter("id <> component_id").select(F.col("id").alias(key))
    else:  # ids are null or repeat: the smallest id, then the row number, null ids last
        rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("own"), F.col(key).alias("row"))
        ranked = rows.select(F.col(key).alias("of"), rank.alias("rank")).join(found, F.col("of") == F.col("id"))
        best = ranked.groupBy("component_id").agg(F.min("rank").alias("best"))
        gone = (found.select(F.col("id").alias(key))
                .join(best.select(F.col("best.row").alias("kept")), F.col(key) == F.col("kept"), "left_anti"))
    return drop_rows(rows, key, gone).select(*docs.columns)
