"""A key holding a third of all rows: results stay exact, work stays split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from portrisk.operators import asof, ml, state


def hot_frame(n: int, seed: int):
    rnd = np.random.default_rng(seed)
    keys = np.where(rnd.random(n) < 1 / 3, 0, rnd.integers(1, 50, n))
    ts = rnd.integers(0, 90 * 86400, n)
    return pd.DataFrame({"k": keys.astype("int64"), "t": ts.astype("int64"),
                         "id": np.arange(n, dtype="int64"), "v": rnd.random(n)})


def test_latest_with_hot_key(spark):
    pdf = hot_frame(30000, 1)
    df = spark.createDataFrame(pdf)
    got = {r.k: r.id for r in state.latest_per_key(df, "k", "t", "id").collect()}
    want = pdf.sort_values(["t", "id"]).groupby("k").tail(1).set_index("k")["id"].to_dict()
    assert got == want


def test_asof_with_hot_key_matches_merge_asof(spark):
    left = hot_frame(20000, 2).drop(columns=["v"])
    right = hot_frame(20000, 3).rename(columns={"id": "rid"})
    l_df = spark.createDataFrame(left).withColumn("ts", F.timestamp_seconds("t"))
    r_df = spark.createDataFrame(right).withColumn("ts", F.timestamp_seconds("t"))
    out = asof.asof_join(l_df, r_df, ["k"], "ts", "ts", {"v": "v", "rid": "rid"}, ["rid"])
    got = out.select("id", "rid").toPandas().sort_values("id").reset_index(drop=True)
    want = pd.merge_asof(left.sort_values("t"), right.sort_values(["t", "rid"])[["k", "t", "rid"]],
                         on="t", by="k", direction="backward", allow_exact_matches=True)
    want = want.sort_values("id").reset_index(drop=True)
    assert (got["rid"].fillna(-1).astype("int64").to_numpy()
            == want["rid"].fillna(-1).astype("int64").to_numpy()).all()


def test_batch_with_one_stamp_is_one_question(spark):
    right = spark.createDataFrame(hot_frame(3000, 6)).withColumn("ts", F.timestamp_seconds("t"))
    stamp = F.timestamp_seconds(F.lit(40 * 86400))
    left = spark.range(50_000).withColumn("ts", F.when(F.col("id") % 10 != 0, stamp))
    out = asof.asof_join(left, right, [], "ts", "ts", {"id": "rid"}, ["id"])
    want = right.filter(F.col("ts") <= stamp).orderBy(F.col("ts").desc(), F.col("id").desc()).first()["id"]
    assert {(r["rid"], r["count"]) for r in out.groupBy("rid").count().collect()} == {(want, 45_000), (None, 5_000)}


def test_asof_with_odd_times(spark):
    """One wrong year must not put all other rows into one range."""
    left = hot_frame(8000, 5).drop(columns=["v"])
    right = hot_frame(8000, 6).rename(columns={"id": "rid"})
    right.loc[0, "t"], left.loc[0, "t"] = 0, 250_000_000_000
    l_df = spark.createDataFrame(left).withColumn("ts", F.timestamp_seconds("t"))
    r_df = spark.createDataFrame(right).withColumn("ts", F.timestamp_seconds("t"))
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out = asof.asof_join(l_df, r_df, ["k"], "ts", "ts", {"rid": "rid"}, ["rid"])
        got = out.select("id", "rid").toPandas().sort_values("id").reset_index(drop=True)
        want = pd.merge_asof(left.sort_values("t"), right.sort_values(["t", "rid"])[["k", "t", "rid"]],
                             on="t", by="k", direction="backward").sort_values("id").reset_index(drop=True)
        assert (got["rid"].fillna(-1).astype("int64").to_numpy()
                == want["rid"].fillna(-1).astype("int64").to_numpy()).all()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scoring_tasks_follow_the_rows(spark):
    assert ml.sized(spark.range(10_001)).rdd.getNumPartitions() == 3
    assert ml.sized(spark.range(1000), rows_each=17).rdd.getNumPartitions() == 4


def test_hot_keys_land_in_several_files_and_pages(spark, tmp_path):
    from portrisk.plans import catalog as C
    from portrisk.sources import html
    data = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("loc"),
                                    F.concat(F.lit("<tr><td>"), "id", F.lit("<td>v"), F.col("id") % 7).alias("tr"))
    dealt = C._dealt(data, "loc", 100)
    assert dealt.count() == 3000 and dealt.filter("loc = 'hot'").select("part").distinct().count() == 10
    assert dealt.filter("loc <> 'hot'").agg(F.max("part")).first()[0] == 0
    pages = html.table_pages(dealt, ["loc", "part"], "id", "tr", "<table><tr><th>Id<th>Value</tr>", "</table>")
    assert pages.filter("loc = 'hot'").count() == 10
    pages = pages.withColumn("page_id", F.xxhash64("loc", "part"))
    read = html.html_tables(pages, keep=["loc"])
    got = {(r.loc, r.cells[0], r.cells[1]) for r in read.collect()}
    assert got == {(r.loc, str(r.id), f"v{r.id % 7}") for r in data.collect()}
    assert read.groupBy("page_id").count().agg(F.max("count")).first()[0] < 160  # about 100 rows a page
    dealt.select("id", "loc").write.partitionBy("loc").csv(str(tmp_path / "files"))
    assert len(list((tmp_path / "files").glob("loc=hot/*.csv"))) > 1
