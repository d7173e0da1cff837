"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-random rotations (three rounds of random signs and a
Hadamard transform) and assigned to the nearest signed axis.  Each table has its own
rotation; a query looks into the buckets of its nearest axes in every table, a share of all axes.
What it finds there is reranked by exact inner products in double precision.  Equal vectors
are indexed once with their smallest ids, and what is too large for a task is split, so a hot
vector or cluster is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk.llm.common import prepare, stored

TABLES = 8
#: Share of the axes that a query probes in every table, by the most components it holds for.
#: In wide spaces the nearest of unrelated vectors are hardly nearer than the rest, and take
#: more axes to find.
SHARES = ((64, 1 / 8), (128, 1 / 6), (math.inf, 1 / 5))
SEED = 2
#: Neighbouring axes whose buckets share a task: a query goes there once for all it probes.
AXES = 32
#: Most index rows and most queries in one task, about.
CHUNK = 16384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x`` (width a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signed_axes(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Closeness of each row to every signed axis after the table's rotation: (rows, 2 * width)."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    turned = np.zeros((len(x), width))
    turned[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
    return np.concatenate([turned, -turned], axis=1)


def default_probes(axes: int) -> int:
    """Axes to probe out of ``axes`` signed ones, by their width."""
    return math.ceil(axes * next(share for width, share in SHARES if axes <= 2 * width))


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component a finite number."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one usable vector for each id, the least one if an id has several.

    Vectors of floats stay floats while they travel; products are in double precision.
    """
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each different vector with its ``most`` smallest ids, ascending.

    More can't be among a query's nearest, as equal vectors tie and the smaller id wins.
    Spark applies the limit before the shuffle too, so a vector with very many copies is small.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return (rows.withColumn("nth", nth).filter(F.col("nth") <= most)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def _axes(batches: Iterator[pa.RecordBatch], tables: int, seed: int) -> Iterator[tuple]:
    """(rows, width, closeness to every axis table by table) for the vectors ``v`` of each batch."""
    for b in batches:
        v = b.column(b.schema.get_field_index("v"))
        sizes = np.array([len(x) for x in v])
        for d in np.unique(sizes):
            part = b.take(pa.array(np.nonzero(sizes == d)[0]))
            x = part.column(b.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(len(part), d).astype(np.float64)
            yield part, pa.array(np.full(len(part), d, np.int32)), (signed_axes(x, t, seed) for t in range(tables))


def placed(index: DataFrame, tables: int, seed: int) -> DataFrame:
    """Every class of ``index`` with the axis nearest to it in each table."""
    kind = index.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, width, tables_ in _axes(batches, tables, seed):
            axis = np.stack([near.argmax(axis=1) for near in tables_], axis=1)
            yield pa.record_batch([*part.columns, width, pa.array(axis.tolist(), pa.list_(pa.int32()))],
                                  names=["v", "ids", "width", "axis"])
    return index.select("v", "ids").mapInArrow(run, f"v {kind}, ids array<long>, width int, axis array<int>")


def probing(queries: DataFrame, probes: int | None, tables: int, seed: int) -> DataFrame:
    """Every query with the axes it probes in each table; without ``probes`` their number
    follows the vectors' width."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, width, tables_ in _axes(batches, tables, seed):
            probed = np.stack([np.argsort(-near, axis=1, kind="stable")[:, :probes or default_probes(near.shape[1])]
                               for near in tables_], axis=1)
            yield pa.record_batch([*part.columns, width, pa.array(probed.tolist(), pa.list_(pa.list_(pa.int32())))],
                                  names=["id", "v", "width", "probed"])
    return queries.select("id", "v").mapInArrow(run, f"id long, v {kind}, width int, probed array<array<int>>")


KEY = ["width", "tab", "grp"]


def dealt(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed`` and ``probing`` rows by ``KEY``: a class once a table with its axis, a query
    once for each group of axes it probes with those axes."""
    group = lambda a: F.floor(a / AXES).cast("int")
    left = (index.select("v", "ids", "width", F.posexplode("axis").alias("tab", "axis"))
            .select("v", "ids", "width", "tab", group(F.col("axis")).alias("grp"), "axis"))
    asked = queries.select("id", "v", "width", F.posexplode("probed").alias("tab", "probed"))
    right = (asked.select("*", F.explode(F.array_distinct(F.transform("probed", group))).alias("grp"))
             .select("id", "v", *KEY, F.filter("probed", lambda a: group(a) == F.col("grp")).alias("probed")))
    return left, right


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added up in the same order for every row."""
    return (q * x).sum(axis=1, dtype=np.float64)


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the k nearest rows of ``x`` to every row of ``q``, ties to smaller ids."""
    out = []
    for at in range(0, len(q), 512):
        part, own = q[at:at + 512], qid[at:at + 512]
        rough = part @ x.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        kth = (np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k
               else np.full(len(part), -np.inf))
        r, c = np.nonzero((rough >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & (rough > -np.inf))  # ties within rounding too
        score = exact_scores(part[r], x[c])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        best = nth < k
        out.append((own[r[best]], ids[c[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (qid[:0], ids[:0], np.zeros(0))


def search(table: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int | None = None,
           seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each query row of ``table``.

    Nearness is the largest inner product, ties go to the smaller id, a query is not its own
    neighbour.  Rows without id and vectors that are null, empty, zero or hold a null or
    non-finite component take no part; vectors are compared with those of the same length; an
    id that comes several times stands for its least vector; other columns are ignored.  A
    query whose buckets hold fewer than k others (or all there are) is compared with every
    row, so none is short.  An empty table gives an empty table.
    """
    prepare(table.sparkSession)
    rows = stored(vectors(table, id_col, vector_col), "vectors")
    index = stored(classes(rows, k + 1), "classes")
    queries = rows.filter(is_query)
    left, right = dealt(stored(placed(index, tables, seed), "placed"), stored(probing(queries, probes, tables, seed), "probing"))
    found = stored(_ranked(_compared(left, right, KEY, k), k), "found")
    # exact way for queries that found fewer than k
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = stored(queries.join(got.withColumnRenamed("query_id", "of"), F.col("id") == F.col("of"), "left")
                   .filter(F.coalesce("n", F.lit(0)) < k).select("id", "v"), "short")
    if not short.isEmpty():
        none, every = F.lit(0), F.array(F.lit(0))  # one axis for all
        whole = _compared(index.withColumn("width", F.size("v")).withColumn("axis", none),
                          short.withColumn("width", F.size("v")).withColumn("probed", every), ["width"], k)
        found = (found.join(short.select(F.col("id").alias("of")), F.col("query_id") == F.col("of"), "left_anti")
                 .unionByName(_ranked(whole, k)))
    return found


def _compared(index: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, id, score): for every query its k nearest of each part of its buckets.

    The index rows (axis) and the queries (probed: axes) of one key are dealt into parts of
    about ``CHUNK``; every part of the one meets every part of the other.  The parts' numbers
    are a written table with a row per key, broadcast by Spark's own check of its size.
    """
    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))
    sizes = stored(parts(index, "x_parts").join(parts(queries, "q_parts"), key)
                   .withColumnsRenamed({c: f"{c}_of" for c in key}), "buckets")
    same = [F.col(c) == F.col(f"{c}_of") for c in key]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (index.join(sizes, same)
            .select(*key, F.pmod(F.xxhash64("v"), F.col("x_parts")).cast("int").alias("x_part"),
                    all_of("q_parts").alias("q_part"), "v", "ids", "axis"))
    right = (queries.join(sizes, same)
             .select(*key, all_of("x_parts").alias("x_part"),
                     F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int").alias("q_part"), "id", "v", "probed"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        copies = [len(i) for i in a["ids"]]
        x = np.repeat(np.stack(a["v"].to_numpy()).astype(np.float64), copies, axis=0)
        ids, axis = np.concatenate(a["ids"].to_list()), np.repeat(a["axis"].to_numpy(), copies)
        q, qid = np.stack(b["v"].to_numpy()).astype(np.float64), b["id"].to_numpy()
        asked, who = np.concatenate(b["probed"].to_list()), np.repeat(np.arange(len(b)), [len(p) for p in b["probed"]])
        got = [nearest(q[w], qid[w], x[axis == one], ids[axis == one], k)
               for one in np.unique(axis) if len(w := who[asked == one])]
        if not got:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        of, found, score = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((found, -score, of))
        of, found, score = of[order], found[order], score[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < k
        return pd.DataFrame({"query_id": of[best], "id": found[best], "score": score[best]})
    on = [*key, "x_part", "q_part"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best different ids of each query, with ranks from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
