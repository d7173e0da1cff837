"""Structured Streaming twins of the batch operators.

Each stream reads landed files incrementally (file source with a declared
schema), applies the *same* DataFrame operator as its batch twin and appends
to a parquet table with a checkpoint, so a restart resumes where it stopped
and a lost executor only re-runs its tasks.  Sinks written from
``foreachBatch`` replace what an earlier try of the same epoch wrote, so a
replayed epoch doesn't duplicate its output.  Tables that epochs read again
are kept in buckets behind a manifest (``buckets``).

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarks; sources
cast it on read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.contingency import Rules, page_alerts, score_alerts
from ..operators.ingest import lineup_from_pages, normalize_weather
from ..operators.state import latest_per_key
from ..functions.scalars import row_hash_id
from ..session import scratch_path
from ..sources.files import split_json_rows, weather_headers, weather_lines, weather_rows
from .buckets import BucketTable, bucket_of


def _start(df: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
           processing_time: str | None = None, mode: str = "append",
           partition_by: Sequence[str] = ()) -> StreamingQuery:
    w = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 hour")
    return w.start(out_path)


# ---------------------------------------------------------------------------
# R1 weather
# ---------------------------------------------------------------------------

def weather_source(spark: SparkSession, landing: str, loc_col: str = "loc_id",
                   max_files: int | None = None) -> DataFrame:
    """Streaming read of ``landing/loc_id=<id>/*.csv``: lines with their files."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return weather_lines(reader, landing, loc_col)


def weather_stream(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                   available_now: bool = True, max_files: int | None = None, run_ts=None) -> StreamingQuery:
    """Landed weather CSV -> P1 -> append to ``fato_clima``, columns by each file's own header."""
    def run(batch: DataFrame, epoch: int) -> None:
        rows = weather_rows(batch, weather_headers(batch))
        _append_epoch(normalize_weather(rows, run_ts=run_ts), out_path, epoch)
    return _each(weather_source(spark, landing, max_files=max_files), run, checkpoint, available_now, "1 hour")


def _append_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Append an epoch's rows to a plain table: its files carry the epoch's number, and files of
    the same epoch that a lost driver left are removed first."""
    spark, base = rows.sparkSession, path.rstrip("/")
    mark = f"epoch-{epoch:09d}-"
    staged = f"{base}/_{mark}staged"  # readers pass over names that begin so
    rows.write.mode("overwrite").parquet(staged)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.globStatus(jpath(f"{base}/{mark}*")):
        fs.delete(s.getPath(), False)
    for s in fs.globStatus(jpath(f"{staged}/*.parquet")):
        if not fs.rename(s.getPath(), jpath(f"{base}/{mark}{s.getPath().getName()}")):
            raise RuntimeError(f"could not move {s.getPath()} to {base}")
    fs.delete(jpath(staged), True)


# ---------------------------------------------------------------------------
# R2 line-up, R3 contingencies (per-batch jobs)
# ---------------------------------------------------------------------------

def pages_source(spark: SparkSession, landing: str, schema: T.StructType = S.PAGES,
                 fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(landing)


def _over_cores(pages: DataFrame) -> DataFrame:
    """Pages of a micro-batch's few files dealt over the cores: parsing them is the work."""
    return pages.repartition(pages.sparkSession.sparkContext.defaultParallelism, "page_id", "html")


def lineup_stream(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                  run_ts, available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """R2: landed line-up pages -> X2 -> append to ``fato_lineup``."""
    pages = pages_source(spark, landing, max_files=max_files)
    return _start(lineup_from_pages(_over_cores(pages), run_ts), out_path, checkpoint, available_now)


def _each(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
          available_now: bool, every: str) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    return w.start()


#: Buckets of batch ids that alerts are kept in.
ALERT_BUCKETS = 64
#: Columns without which a scored row is rejected.
CONTINGENCY_REQUIRED = ("cont_id", "loc_id", "timestamp_leitura", "score_risco")


def contingency_stream(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                       run_ts_of: Callable[[int], object], rules: Rules = Rules(),
                       available_now: bool = True, max_files: int | None = None,
                       buckets: int = ALERT_BUCKETS) -> StreamingQuery:
    """Landed pages -> X5, one row per batch id, also when its pages arrive apart.

    Each micro-batch adds the alerts of its pages to a table in buckets of batch ids, then
    scores every batch it touches from all its alerts so far; only touched buckets are read.
    A null batch id is a batch like any other.  Scored rows go through the row insert (S6):
    rows that miss a required column or don't fit the table are kept as (batch_id, raw,
    reason) in ``rejects``.  ``run_ts_of(epoch)`` gives the run stamp of an epoch (fixed per
    epoch, so a replay writes the same rows).  Scores go to ``scores/epoch=<n>``, rejects to
    ``rejects/epoch=<n>`` below ``out_path`` with overwrite: replay-safe.
    """
    base = out_path.rstrip("/")

    def run(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        table = BucketTable(s, f"{base}/alerts")
        new = page_alerts(_over_cores(batch), rules).withColumn("bucket_key", bucket_of(["batch_id"], buckets))
        staged = scratch_path(s, "alerts")  # pages are parsed once
        new.write.parquet(staged)
        new = s.read.schema(new.schema).parquet(staged)
        folders, touched = table.add(new, epoch)
        alerts = table.read(T.StructType(new.schema.fields[:-1]), folders, touched).drop("bucket_key")
        seen = new.select(F.col("batch_id").alias("of")).distinct()
        alerts = alerts.join(seen, F.col("batch_id").eqNullSafe(F.col("of")), "left_semi")
        rows = score_alerts(alerts, run_ts_of(epoch), rules)
        texts = rows.select("batch_id", F.to_json(F.struct(*[F.col(c) for c in S.FATO_CONTINGENCIAS.fieldNames()]),
                                                  {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))
        good, bad = split_json_rows(texts, S.FATO_CONTINGENCIAS, keep=["batch_id"], required=CONTINGENCY_REQUIRED)
        good.select(*S.FATO_CONTINGENCIAS.fieldNames(), "batch_id").write.mode("overwrite").parquet(
            f"{base}/scores/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{base}/rejects/epoch={epoch}")
    return _each(pages_source(spark, landing, max_files=max_files), run, checkpoint, available_now, "1 hour")


def read_rejects(spark: SparkSession, out_path: str) -> DataFrame:
    """Scored rows that the table did not take: (batch_id, raw, reason, epoch)."""
    return spark.read.parquet(f"{out_path.rstrip('/')}/rejects")


def read_contingencies(spark: SparkSession, out_path: str) -> DataFrame:
    """Current row of every batch id: that of the last epoch that touched it."""
    scores = spark.read.parquet(f"{out_path.rstrip('/')}/scores")
    return latest_per_key(scores, "batch_id", "epoch", "cont_id").drop("epoch")


# ---------------------------------------------------------------------------
# R4 live latest state, R5 late and repeated readings
# ---------------------------------------------------------------------------

#: Buckets the live state is dealt into by key; a micro-batch rewrites those it touches.
STATE_BUCKETS = 64


def latest_stream(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  out_path: str, checkpoint: str, available_now: bool = True,
                  buckets: int = STATE_BUCKETS) -> StreamingQuery:
    """Newest row per key, merged into one table with a row per key.

    A micro-batch is reduced to its newest row per key and merged with the buckets of the
    table it touches.  Merged buckets are new folders, and one rename of a manifest makes them
    the table's: a driver lost at any time leaves the old table or the new one.  Merging a
    row again changes nothing, so a replayed epoch, or a lost checkpoint, gives the same table.
    """
    table = BucketTable(stream.sparkSession, f"{out_path.rstrip('/')}/state")
    if not table.versions():
        table.commit(0, {}, stream.schema)
    newest = lambda df: latest_per_key(df, list(keys), list(order_by[:1]), list(order_by[1:]) or list(order_by))

    def run(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        new = newest(batch).withColumn("bucket_key", bucket_of(keys, buckets))
        staged = scratch_path(s, "changes")
        new.write.parquet(staged)
        new = s.read.schema(new.schema).parquet(staged)
        touched = [r["bucket_key"] for r in new.select("bucket_key").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        version, folders = table.versions()[-1], table.folders()
        schema = T.StructType(new.schema.fields[:-1])
        merged = newest(new.unionByName(table.read(schema, folders, touched)))
        name, _ = table.write(merged)
        table.commit(version + 1, folders | {b: [name] for b in touched}, schema)
    return _each(stream, run, checkpoint, available_now, "1 minute")


def read_latest(spark: SparkSession, out_path: str) -> DataFrame:
    """Current state of ``latest_stream``: one row per key, all as of one manifest."""
    table = BucketTable(spark, f"{out_path.rstrip('/')}/state")
    return table.read(table.schema(), table.folders()).drop("bucket_key")


#: Buckets of key hashes in each day of the index of readings.
KEY_BUCKETS = 4


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str, out_path: str,
                 checkpoint: str, available_now: bool = True, buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Each reading of (location, time) once, however late it comes.

    An index holds the digests of all keys in buckets of day and key hash; a micro-batch reads
    the buckets it touches, appends the readings whose digests are not there, and adds their
    digests.  Null is a value like any other in a key, and readings without a time have a
    bucket of their own.  Nothing is dropped for being old: a new location's history is
    appended like any other.  An epoch's readings go to their own folder with overwrite, and
    an epoch once more starts from the index before it: replay-safe.
    """
    base = out_path.rstrip("/")
    index = BucketTable(stream.sparkSession, f"{base}/keys")
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(f"{base}/rows")

    def run(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        new = latest_per_key(batch, list(keys), event_time, [c for c in batch.columns if c not in keys])
        day = F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit("none"))
        new = new.select("*", row_hash_id(*[F.col(k) for k in keys]).alias("key_digest"),
                         F.concat(day, F.lit("-"), bucket_of(keys, buckets)).alias("bucket_key"))
        staged = scratch_path(s, "readings")
        new.write.parquet(staged)
        new = s.read.schema(new.schema).parquet(staged)
        touched = [r["bucket_key"] for r in new.select("bucket_key").distinct().collect()]  # days of the batch x ``buckets``
        digest = T.StructType([T.StructField("key_digest", T.StringType())])
        old = index.read(digest, index.folders(before=epoch), touched).select("key_digest")
        new = new.join(old, "key_digest", "left_anti")
        new.drop("key_digest", "bucket_key").write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")
        index.add(new.select("key_digest", "bucket_key"), epoch)
    return _each(stream, run, checkpoint, available_now, "1 hour")


def read_deduplicated(spark: SparkSession, out_path: str) -> DataFrame:
    """The readings of ``dedup_stream``."""
    return spark.read.parquet(f"{out_path.rstrip('/')}/rows").drop("epoch")


__all__ = ["weather_source", "weather_stream", "pages_source", "lineup_stream",
           "contingency_stream", "read_contingencies", "latest_stream", "read_latest", "dedup_stream",
           "read_deduplicated", "read_rejects"]
