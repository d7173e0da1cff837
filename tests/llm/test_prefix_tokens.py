import random

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from portrisk.llm import prefix_tokens
from portrisk.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    rng = random.Random(seed)
    alphabet = "aeiou bcdst  .,!?'\n\t0129<s></s><unk>▁ßéñ☃😀漢\x00-_(){}=\"THE the of ing tion "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_every_prefix_equals_the_library():
    counter = prefix_tokens.PrefixCounter(MODEL)
    real = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.str.slice(100, 400).tolist()
    for t in ["", " ", "  ", "\n", "▁", "a", " a  b ", "<s>x</s>", *texts(300, 1), *real[:40]]:
        want = [len(SP.encode(t[:k])) for k in range(1, len(t) + 1)]
        assert counter.prefixes(t).tolist() == want
        assert counter.total(t) == (want[-1] if want else 0)


def test_forgetting_does_not_change_counts(monkeypatch):
    monkeypatch.setattr(prefix_tokens, "KEEP", 7)
    counter = prefix_tokens.PrefixCounter(MODEL)
    for t in texts(200, 2):
        assert counter.total(t) == len(SP.encode(t))


def test_query_equals_the_library(spark):
    got = QUERIES["op5_prefix_tokens"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").loc[got.index]
    assert got.n_tokens.tolist() == [len(x) for x in SP.encode(docs.text.tolist(), num_threads=1)]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert (got.over_limit == (got.n_tokens > 4096)).all() and got.over_limit.any()


def test_truncation_from_the_stored_table(spark):
    rows = [(1, None), (2, ""), (None, "one two three four five six"), (3, "again again"), (3, "again again"),
            (4, "long text ☃ " * 3000)] + list(enumerate(texts(40, 3), 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix", F.lit("x")).repartition(3)
    counted = prefix_tokens.token_counts(docs, MODEL).collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in counted) == sorted((str(i), len(SP.encode(t or ""))) for i, t in rows)
    table = prefix_tokens.prefix_table(docs, MODEL)
    for budget in (0, 1, 5, 40):
        for r in prefix_tokens.truncated(table, budget).withColumn("fits", prefix_tokens.fits(F.col("prefix"), budget)).collect():
            t = r["text"]
            best = max((k for k in range(len(t[:400]) + 1) if len(SP.encode(t[:k])) <= budget), default=0)
            assert r["cut_text"] == t[:best] and r["cut_tokens"] == len(SP.encode(t[:best]))
            assert r["fits"] == (len(SP.encode(t)) <= budget)
    assert prefix_tokens.token_counts(docs.limit(0), MODEL).count() == 0
