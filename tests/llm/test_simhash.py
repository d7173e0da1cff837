import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from portrisk.llm import simhash
from portrisk.llm.components import connected_components
from portrisk.llm.queries import QUERIES

UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    comp = list(range(len(x)))
    for i in range(len(x)):
        stack = [i] if comp[i] == i else []
        seen = set(stack)
        while stack:
            for j in near[stack.pop()].nonzero()[0]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        if seen:
            for j in seen:
                comp[j] = i
    least = {}
    for c, i in zip(comp, ids):
        least[c] = min(least.get(c, i), i)
    return [least[c] for c in comp]


def test_fingerprint_equals_brute_force():
    for t in [None, "", " \t\n", "one", "One TWO", "a b c d", "a b c d e f a b c d", "É x Ünder y z w",
              " ".join(f"w{i % 7} x{i}" for i in range(900)), "same " * 2000]:
        assert simhash.fingerprint(simhash.shingle_hashes(t or "")) == brute_fingerprint(t)


def test_query_equals_brute_force(spark, tmp_path):
    got = QUERIES["op1_simhash"](spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == brute_components(fps, docs.doc_id.tolist())
    assert got.component_id.nunique() < len(got)


def test_tiles_link_everything_within_radius(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    fps = set()
    for s in seeds:  # a hot ball of close fingerprints and chains of steps of four bits
        x = int(s)
        for _ in range(12):
            fps.add(x)
            for b in rng.choice(64, 4, replace=False):
                x ^= 1 << int(b)
    hot = int(seeds[0])
    fps |= {hot ^ 1 << i for i in range(64)} | {hot ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    for tile in (50, 1 << 18):
        edges = simhash.links(df, 4, tile)
        rows = connected_components(edges).toPandas()
        root = dict(zip(rows.node, rows.root))
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        got = [root.get(f, f) for f in signed]
        assert got == brute_components(fps, signed)
        assert edges.count() < 40 * len(fps)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b c d e", 3), (5, "A b C d e", 4), (5, "a b c d e", 4),
            (7, "x " * 200000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["component_id"])
    assert by == {1: {1}, 2: {1}, None: {5}, 5: {5}, 7: {7}}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 37, 200])
def test_components_of_a_path(spark, n):
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    got = connected_components(df).collect()
    assert sorted(r["node"] for r in got) == list(range(n + 1)) and {r["root"] for r in got} == {0}
