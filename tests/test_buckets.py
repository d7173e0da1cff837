"""Bucket tables (R3-R5): atomic changes, null keys, rejects, reads bounded by touched buckets."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from portrisk import schemas as S
from portrisk.operators import contingency, ingest, state
from portrisk.streaming import buckets, streams

from .conftest import rows

T0, DAY = dt.datetime(2026, 1, 1), dt.timedelta(days=1)
READING = "loc_id string, timestamp_leitura timestamp, v double, id long"


def land(spark, path, name, data, schema=READING):
    spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}")


def source(spark, landing, schema=READING, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing + "/*")


def test_add_appends_replays_and_writes_full_buckets_anew(spark, scratch, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_FOLDERS", 3)
    table = buckets.BucketTable(spark, scratch("t"))
    frame = lambda n: spark.createDataFrame([(n, "a"), (n + 100, "b")] if n % 2 else [(n, "a")], "v long, bucket_key string")
    schema = frame(0).drop("bucket_key").schema
    for n in range(8):
        folders, touched = table.add(frame(n), n)
        assert touched == (["a", "b"] if n % 2 else ["a"]) and all(len(f) <= 3 for f in folders.values())
        again, _ = table.add(frame(n), n)  # the same epoch once more
        assert rows(table.read(schema, again), "v") == rows(table.read(schema, table.folders()), "v")
    assert rows(table.read(schema, table.folders(), ["a"]), "v") == [(n,) for n in range(8)]
    assert rows(table.read(schema, table.folders(), ["b"]), "v") == [(n,) for n in (101, 103, 105, 107)]
    assert len(table.versions()) <= buckets.KEEP and table.read(schema, {}).count() == 0
    named = {f for v in table.versions() for fs in table._manifest(v)["folders"].values() for f in fs}
    assert {n.removeprefix("bucket_write=") for n in table._names("data")} == named  # nothing else is left


def test_latest_survives_a_crash_between_writing_and_switching(spark, scratch, monkeypatch):
    landing, out, ckpt = scratch("l"), scratch("o"), scratch("c")
    first = [(f"L{i}", T0, float(i), i) for i in range(40)] + [(None, T0, 1.0, 99), ("L0", None, 7.0, 98)]
    land(spark, landing, "a", first)
    start = lambda: streams.latest_stream(source(spark, landing), ["loc_id"], ["timestamp_leitura", "id"], out, ckpt)
    start().awaitTermination()
    second = [(f"L{i}", T0 + DAY, -float(i), 100 + i) for i in range(0, 40, 2)] + [("L1", T0 - DAY, 5.0, 200), (None, T0 + DAY, 2.0, 201)]
    land(spark, landing, "b", second)
    want = rows(state.latest_per_key(spark.createDataFrame(first + second, READING), "loc_id", "timestamp_leitura", "id"))
    before = rows(streams.read_latest(spark, out))
    commit = buckets.BucketTable.commit

    def crash(self, version, folders, schema):
        name = next(n for n in self._names("data") if n.removeprefix("bucket_write=") not in
                    {f for fs in self.folders().values() for f in fs})
        gone = self._paths(f"{self.path}/data/{name}/{self._names(f'data/{name}')[0]}")
        self._fs.delete(gone, True)  # a written bucket is lost with the driver
        raise RuntimeError("driver lost")
    monkeypatch.setattr(buckets.BucketTable, "commit", crash)
    with pytest.raises(Exception, match="driver lost"):
        start().awaitTermination()
    assert rows(streams.read_latest(spark, out)) == before  # the old table, whole
    monkeypatch.setattr(buckets.BucketTable, "commit", commit)
    start().awaitTermination()
    assert rows(streams.read_latest(spark, out)) == want
    streams.latest_stream(source(spark, landing), ["loc_id"], ["timestamp_leitura", "id"], out, scratch("c2")).awaitTermination()
    assert rows(streams.read_latest(spark, out)) == want  # all of it again, as after a lost checkpoint


def test_dedup_equals_batch_with_null_keys_and_reads_touched_buckets_only(spark, scratch, monkeypatch):
    landing, out, ckpt = scratch("l"), scratch("o"), scratch("c")
    base = [("A", T0, 1.0, 1), ("A", None, 2.0, 2), (None, T0, 3.0, 3), (None, None, 4.0, 4)]
    epochs = [base + [("A", T0, 1.0, 1)], base, base + [("B", T0 + 5 * DAY, 5.0, 5)], [("B", T0 + 5 * DAY, 5.0, 5), ("C", T0 + 9 * DAY, 6.0, 6)]]
    reads = []
    read = buckets.BucketTable.read

    def seen(self, schema, folders, chosen=None):
        reads.append((sorted(chosen), sorted(folders)))
        return read(self, schema, folders, chosen)
    monkeypatch.setattr(buckets.BucketTable, "read", seen)
    for n, data in enumerate(epochs):
        land(spark, landing, f"run{n}", data)
        streams.dedup_stream(source(spark, landing, files=10), ["loc_id", "timestamp_leitura"], "timestamp_leitura", out, ckpt,
                             buckets=1).awaitTermination()
    everything = spark.createDataFrame([r for e in epochs for r in e], READING)
    want = state.latest_per_key(everything, ["loc_id", "timestamp_leitura"], "id", "v")
    assert rows(streams.read_deduplicated(spark, out)) == rows(want) and want.count() == 6
    assert ingest.dedup_readings(everything.withColumn("inserido_em", F.lit(T0))).count() == 6  # E5
    asked = [c for c, _ in reads]
    assert asked[-1] == ["2026-01-06-0", "2026-01-10-0"]  # not the first day, nor the readings without a time
    assert "none-0" in asked[0] and len(asked) == 4


def test_dedup_replays_an_epoch_after_the_index_knew_it(spark, scratch, monkeypatch):
    landing, out, ckpt = scratch("l"), scratch("o"), scratch("c")
    land(spark, landing, "a", [("A", T0, 1.0, 1)])
    add = buckets.BucketTable.add

    def crash(self, new, version):
        add(self, new, version)
        raise RuntimeError("driver lost")  # before the checkpoint has the epoch
    monkeypatch.setattr(buckets.BucketTable, "add", crash)
    start = lambda: streams.dedup_stream(source(spark, landing), ["loc_id", "timestamp_leitura"], "timestamp_leitura", out, ckpt)
    with pytest.raises(Exception, match="driver lost"):
        start().awaitTermination()
    monkeypatch.setattr(buckets.BucketTable, "add", add)
    start().awaitTermination()
    assert rows(streams.read_deduplicated(spark, out)) == [("A", T0, 1.0, 1)]


def test_contingency_null_batch_rejects_and_touched_buckets(spark, scratch, monkeypatch):
    landing, out, ckpt, run = scratch("l"), scratch("o"), scratch("c"), dt.datetime(2026, 1, 1)
    road = "<p>interdi&ccedil;&atilde;o total"
    news = "<a class='feed-post-link'>paralisa&ccedil;&atilde;o</a>"
    epochs = [[(1, None, "road", road), (2, "b", "road", road)], [(3, None, "news", news)], [(4, "c", "road", "ok")],
              [(5, "b", "news", news)]]
    stamps = {0: run, 1: run, 2: None, 3: run}  # the third run has no stamp: its row can't be inserted
    asked = []
    read = buckets.BucketTable.read
    monkeypatch.setattr(buckets.BucketTable, "read", lambda self, schema, folders, chosen=None:
                        (asked.append((len(chosen), len(folders))), read(self, schema, folders, chosen))[1])
    for data in epochs:
        spark.createDataFrame(data, S.PAGES).write.mode("append").parquet(landing)
        streams.contingency_stream(spark, landing, out, ckpt, lambda e: stamps[e], max_files=100).awaitTermination()
    got = streams.read_contingencies(spark, out)
    pages = spark.createDataFrame([p for e in epochs for p in e if p[1] != "c"], S.PAGES)
    batch = contingency.score_contingencies(pages, run).select(*got.columns)
    assert rows(got) == rows(batch) and {r.batch_id for r in got.collect()} == {None, "b"}
    bad = streams.read_rejects(spark, out).collect()
    assert [(r.batch_id, r.reason, r.epoch) for r in bad] == [("c", "NULL in required column timestamp_leitura", 2)]
    assert '"score_risco":0.0' in bad[0].raw
    assert asked[-1][0] == 1 and asked[-1][1] >= 2  # one bucket of several


def test_hot_batch_is_joined_in_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [("hot" if k % 3 == 0 else None if k % 3 == 1 else f"b{k % 50}", k % 2, k // 7, k % 7, 0.1, f"m{k}" if k % 5 else None)
                for k in range(3000)]
        alerts = spark.createDataFrame(data, "batch_id string, src int, page_id int, ord int, weight double, message string")
        order = ["batch_id", "src", "page_id", "ord", "message"]
        spread = alerts.repartitionByRange(*order).withColumn("p", F.spark_partition_id()).filter("batch_id = 'hot'")
        assert spread.select("p").distinct().count() >= 3
        got = {r.batch_id: (r.texto_original, r.score_risco, r.json_extraido) for r in
               contingency.score_alerts(alerts, T0, contingency.Rules(cap=1e9)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for b, *rest in sorted(data, key=lambda r: (r[1], r[2], r[3], r[5] or "")):
        want.setdefault(b, []).append(rest)
    assert set(got) == set(want)
    for b, found in want.items():
        texts = [r[4] for r in found if r[4]]
        assert got[b] == (S.TEXT_JOIN.join(texts) if texts else S.NO_ALERT_TEXT, round(len(found) * 0.1, 9), f'{{"alertas":{len(texts)}}}')
