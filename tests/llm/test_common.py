import zlib

import __spark_entry__ as E
from portrisk.llm import common
from portrisk.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_keys_are_unique_and_never_null(spark):
    plain = spark.range(50).withColumnRenamed("id", "doc_id")
    assert common.keyed(plain)[1] == "doc_id" and common.keyed(plain.limit(0))[1] == "doc_id"
    odd = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, row_key string").repartition(3)
    rows, key = common.keyed(odd)
    assert key == "row_key_" and rows.select(key).distinct().count() == 3
    assert sorted(r[key] for r in rows.collect()) == sorted(r[key] for r in rows.collect())


def test_dropping_rows_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, i * 2) for i in range(20)], "doc_id long, GONE_key long")
    out = common.drop_rows(docs, "doc_id", docs.filter("doc_id % 3 = 0"))
    assert out.columns == docs.columns and sorted(r[0] for r in out.collect()) == [i for i in range(20) if i % 3]


def test_folds_and_samples(spark):
    ids = spark.range(300).withColumnRenamed("id", "doc_id")
    held = {r["doc_id"] for r in ids.filter(common.held_out()).collect()}
    assert held == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    twice = ids.union(ids).union(spark.createDataFrame([(None,)], "doc_id long"))
    some = common.sample_ids(twice, 40)
    assert len(set(some)) == 40 and some == common.sample_ids(twice.repartition(7), 40)
    assert len(common.sample_ids(ids, 1000)) == 300
    texts = common.texts_of(ids.withColumn("text", F.lit("t")).withColumn("wanted", F.lit(1)), {3, 5})
    assert sorted(r["id"] for r in texts.collect()) == [3, 5]
    assert not ids.filter(common.in_training() & common.held_out()).count()
