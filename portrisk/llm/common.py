"""Helpers shared by the operators: written intermediate tables, row keys, Arrow streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk.session import apply_session_conf, ensure_checkpoint_dir, scratch_path

#: Rows per Arrow batch handed to Python workers: texts may be long, so few at a time.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on, and the shared folder."""
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs read the table, also after an executor was lost, and
    values such as row ids stay as written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch (streamed; one batch in memory at a time)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)
    return df.mapInArrow(run, schema)


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column that is unique and never null, and that column's name.

    This is ``id_col`` itself when no id is null or repeated (one aggregate over the id
    column decides).  Otherwise rows are numbered and cut by ``checkpoint()``, so that the
    numbers are the same for every job that reads them.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bad = (docs.groupBy(F.col(id_col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("k").isNull() | (F.col("n") > 1)))
    if bad.isEmpty():
        return docs, id_col
    name = free_name(docs, "row_key")
    return docs.withColumn(name, F.monotonically_increasing_id()).checkpoint(), name


def drop_rows(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``.

    The dropped keys are written first, so that Spark knows their size: it broadcasts them
    below its threshold and shuffles both sides beyond it.
    """
    name = free_name(docs, "gone_key")
    gone = stored(dropped.select(F.col(key).alias(name)), "dropped")
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def in_training(id_col: str = "doc_id") -> Column:
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def sample_ids(rows: DataFrame, most: int, id_col: str = "doc_id", seed: int = 11) -> list[int]:
    """At most ``most`` distinct ids of ``rows``, those with the smallest hashes, in that order."""
    ids = rows.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    return [r["id"] for r in ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).collect()]


def texts_of(docs: DataFrame, ids: set[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the rows with these few ids (a broadcast of a bounded list; no shuffle)."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "wanted long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi")
