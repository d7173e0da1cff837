import collections
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as P
from portrisk.llm import toxicity
from portrisk.llm.queries import QUERIES
from tests.llm.test_cuckoo import UPPER
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import check_places, library_ids
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, each read by the next as written."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for df in stages[1:5]:
        assert df.columns.tolist() == stages[0].columns.tolist()


def test_toxicity_stage(spark, stages):
    said = QUERIES["op3_toxicity"](spark, SF).toPandas().set_index("doc_id").predicted
    before, after = stages[0], stages[1]
    assert sorted(after.doc_id) == sorted(i for i in before.doc_id if not said[i]) and said.sum() > 0
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    gone = [i for i in before.doc_id if said[i] and i in labels.index]
    assert labels[gone].mean() > 0.9


def test_exact_stage(stages):
    want = collections.defaultdict(int)
    for r in stages[1].itertuples():
        want[r.text.translate(UPPER)] = max(want[r.text.translate(UPPER)], r.doc_id)
    assert sorted(stages[2].doc_id) == sorted(want.values()) and len(want) < len(stages[1])


def test_near_stage(stages):
    docs = stages[2].sort_values("doc_id")
    component = brute_components([brute_fingerprint(t) for t in docs.text], docs.doc_id.tolist())
    assert sorted(stages[3].doc_id) == sorted(set(component))


def test_mixing_stage(stages):
    size = {r.doc_id: len(r.text.split()) for r in stages[3].itertuples()}
    source = dict(zip(stages[3].doc_id, stages[3].source))
    copies = collections.Counter(stages[4].doc_id)
    assert max(copies.values()) <= 3
    sums, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, n in size.items():
        sums[source[i]] += n
        taken[source[i]] += n * copies[i]
        largest[source[i]] = max(largest[source[i]], n)
    for s, t in brute_targets(dict(sums)).items():
        assert abs(taken[s] - t) <= 1.5 * largest[s]


def test_packing_stage(stages):
    docs, packed = stages[4], stages[5]
    ids = dict(zip(docs.doc_id, library_ids(docs.text)))
    want = collections.Counter()
    for i in docs.doc_id:
        own = np.array([*ids[i], 2], "<u4")
        first = len(own) % 1024 or 1024
        cuts = [0, *range(first, len(own) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(
        index=False, name=None)) == want
    n = check_places(zip(packed.sequence_id, packed.offset, packed.length), 1024)
    assert n <= -(-int(packed.length.sum()) // 1024) * 1.01 + 2


def test_run_gives_the_same_rows(spark, stages):
    got = P.run(spark, SF).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(stages[5].itertuples(index=False, name=None))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, 0), (None, "no id here at all", "en", "a", 1), (None, "no id here at all", "en", "a", 1),
            (2, "", "en", "a", 0), (3, "Same text of five words", "en", "b", 1), (3, "same TEXT of five words", "en", "b", 1),
            (4, "row row row row row", "en", None, 1), (4, "row row row row row", "en", None, 1), (5, "long " * 200000, "en", "b", 1)]
    spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for data in (docs, docs.limit(0)):
        at = data
        counts = []
        for name, stage in P.STAGES:
            at = P.stored(stage(spark, at, str(tmp_path)), name)
            counts.append(at.count())
        if data is docs:  # five different texts, none near another
            assert counts[:3] == [9, 5, 5] and counts[4] > 0
            assert at.filter("length > 1024").count() == 0
        else:
            assert counts == [0] * 5
