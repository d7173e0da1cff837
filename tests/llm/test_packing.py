import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from portrisk.llm import packing
from portrisk.llm.bpe import byte_bpe
from portrisk.llm.queries import QUERIES

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken"))


def library_ids(texts):
    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def check_places(rows, limit):
    """Every sequence is filled from 0 without gaps and holds ``limit`` at most."""
    by = {}
    for seq, off, n in rows:
        by.setdefault(seq, []).append((off, n))
    for got in by.values():
        at = 0
        for off, n in sorted(got):
            assert off == at
            at += n
        assert at <= limit
    return len(by)


def test_ids_equal_the_library():
    rng = random.Random(4)
    alphabet = "aA zé ß.,!?'s't 09\n\t  <|endoftext|>_-¡¿ñ\x1c\x85\xa0 —“”漢字б☃😀"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 3000, "word\n" * 900, "don't I'll  we've\n\n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(1500)]
    texts += ["".join(chr(rng.randint(1, 0x24F)) for _ in range(200)) for _ in range(500)]
    texts += pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist()
    bpe = byte_bpe(JSON, RANKS)
    for t, ids in zip(texts, library_ids(texts)):
        assert bpe.encode(t).tolist() == ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 300))
    counts = np.zeros(limit + 1, np.int64)
    for n in rng.integers(1, limit + 1, int(rng.integers(0, 5000))) if seed % 2 else \
            np.minimum(limit, rng.geometric(8 / limit, 4000)):
        counts[n] += 1
    plan = packing.plan(counts)
    used = np.zeros(limit + 1, np.int64)
    for pattern, k in plan:
        assert k > 0 and sum(pattern) <= limit
        for n in pattern:
            used[n] += k
    assert (used == counts).all()
    least = -(-int((counts * np.arange(limit + 1)).sum()) // limit)
    opened = sum(k for _, k in packing.best_fit(counts))
    assert least <= sum(k for _, k in plan) <= opened * 1.01 + 2


def test_fitted_patterns_fill_most_of_a_smooth_histogram():
    counts = np.zeros(1025, np.int64)
    counts[1:] = 3_000_000 // np.arange(60, 1084)
    patterns = packing.exact_patterns(np.nonzero(counts)[0], 1024)
    assert (patterns.sum(axis=1) == 1024).all() and (np.diff(patterns, axis=1) <= 0).all()
    x = packing.fit(patterns, counts)
    left = counts - np.bincount(patterns.ravel(), np.repeat(x, 3), 1025)
    left[0] = 0
    assert (x >= 0).all() and np.linalg.norm(left * np.arange(1025)) < 0.1 * np.linalg.norm(counts * np.arange(1025))


def test_query_equals_brute_force(spark):
    got = QUERIES["op10_packing"](spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    ids = dict(zip(docs.doc_id, library_ids(docs.text)))
    tokens = 0
    for doc, g in got.sort_values("piece").groupby("doc_id"):
        own = np.array([*ids[doc], 2], "<u4")
        tokens += len(own)
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() == len(own) and (g.length.iloc[1:] == 1024).all() and g.length.iloc[0] <= 1024
        assert g.ids_crc32.tolist() == [zlib.crc32(own[s:s + n].tobytes()) for s, n in zip(g.start, g.length)]
    assert set(got.doc_id) == set(docs.doc_id)
    n = check_places(zip(got.sequence_id, got.offset, got.length), 1024)
    assert n <= -(-tokens // 1024) * 1.01 + 1


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "", 5), (None, "null id", 5), (2, "twice " * 40, 5), (2, "twice " * 40, 5),
            (3, "long " * 50000, 5)] + [(10 + i, "hot hot", 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    got = packing.packed(docs, JSON, RANKS, limit=64).collect()
    want = sum(len(packing.cuts(len(x) + 1, 64)) for x in library_ids([r[1] or "" for r in rows]))
    assert len(got) == want
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    assert packing.packed(docs.limit(0), JSON, RANKS).count() == 0
