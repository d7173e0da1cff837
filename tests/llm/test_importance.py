import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from portrisk.llm import importance
from tests.llm.test_cuckoo import UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, bucket int"


def brute_buckets(text):
    words = WORD.findall((text or "").translate(UPPER))
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of every (doc_id, text)."""
    s, t = Counter(), Counter()
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            into.update(brute_buckets(text))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
            for b in range(10000)]
    out, fit = [], []
    for k, (i, text) in enumerate(docs):
        found = brute_buckets(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        out.append([i, len(found), weight, score, None])
        if len(WORD.findall((text or "").translate(UPPER))) >= 20:
            fit.append(k)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for r, k in enumerate(fit[:percent * len(fit) // 100]):
        out[k][4] = r + 1
    return sorted(map(str, out))


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["word", "Wörd", "ÄRGER", "İx", "東京", "x1", "A", "b", "den", "\U0001F600go", "q" * 70]
    between = [" ", "  ", "\n", ", ", "\x00", "-", "\x7f", "'"]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice(between) for _ in range(rng.randrange(120)))) for i in range(n)]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_windows_over_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in [None, "", " ", "one", "one Two", *[t for _, t in made(80, 3)]]:
        got = list(importance.windows(text))
        want = Counter(brute_buckets(text))
        assert Counter(int(x) % 10000 for _, f in got for x in f) == want
        assert sum(n for n, _ in got) == len(WORD.findall((text or "").translate(UPPER)))


@pytest.mark.parametrize("tasks", [1, 7])
def test_ranks_against_brute_force(spark, tasks):
    docs = [*made(300, 1), (300, None), (301, ""), (None, "no id " * 30), (5, "again " * 40), (5, "again " * 40),
            (302, "long " * 60000), (303, "word " * 19), (304, "word " * 20)]
    target = [*made(20, 2), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(tasks)
    aim = spark.createDataFrame([(i, t, "x", 1) for i, t in target], SCHEMA)
    got = importance.ranked(frame, aim).select("id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(list(r)) for r in got) == brute(docs, target)


def test_empty_tables(spark):
    some = spark.createDataFrame([(i, t, "x", 1) for i, t in made(60, 4)], SCHEMA)
    assert importance.ranked(some.limit(0), some).count() == 0
    got = importance.ranked(some, some.limit(0)).select("id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(list(r)) for r in got) == brute(made(60, 4), [])


def test_drawn_rows_lean_to_the_target(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["sea", "port", "ship", "quay"] if i % 10 == 0 else ["hill", "road", "tree", "sheep"])
                         for _ in range(40)), "k", i) for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, drawn_key string, id int").repartition(5)
    out = importance.resampled(frame, frame.filter("doc_id % 10 = 0").limit(30))
    assert out.columns == frame.columns and out.count() == 50
    assert out.filter(F.col("doc_id") % 10 == 0).count() == 50
    twice = frame.union(frame)
    assert importance.resampled(twice, frame.limit(0)).count() == 100
