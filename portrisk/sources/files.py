"""File sources and sinks.

Every reader declares its schema (no inference); every writer appends whole
DataFrames in one distributed write action.  Counts of written rows come
from ``Observation`` on the write itself, not from a second scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import date_text, timestamp_text
from ..session import scratch_path

CORRUPT = "_corrupt_record"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to ``schema``.

    A missing column is an AnalysisException; NULL in a column that is not nullable fails the
    job with that column's name (file tables keep no NOT NULL of their own).
    """
    def column(f: T.StructField) -> Column:
        value = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(f"NULL in required column {f.name}").cast(f.dataType))
        return value.alias(f.name)
    return df.select(*[column(f) for f in schema.fields])


# ---------------------------------------------------------------------------
# S1 weather CSV
# ---------------------------------------------------------------------------

_FIELD = r'("(?:[^"]|"")*"|[^,"]*),'


def _fields(line: Column) -> Column:
    """Fields of one CSV line, unquoted."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_FIELD), F.lit(1))
    return F.transform(raw, lambda x: F.when(
        x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))


def weather_lines(reader, path: str | Sequence[str], loc_col: str = "loc_id") -> DataFrame:
    """Lines of the landed weather exports: (loc_col, file, start, value).

    ``reader`` is ``spark.read`` or ``spark.readStream``.  A file of any size is split among
    tasks; ``start`` is where a line's split begins.  The location is the ``loc_col=<id>``
    folder, whether one path or a list of paths is given, and empty without one.  (Its name is
    decoded twice: as a path's text and as a partition folder's.)
    """
    texts = reader.option("recursiveFileLookup", True).text(path if isinstance(path, str) else list(path))
    at = F.col("_metadata.file_path")
    return texts.select(F.try_url_decode(F.try_url_decode(F.regexp_extract(at, rf"/{loc_col}=([^/]+)/", 1))).alias(loc_col),
                        at.alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.regexp_replace("value", "^\ufeff", "").alias("value"))


def weather_headers(lines: DataFrame, schema: T.StructType = S.WEATHER_CSV, loc_col: str = "loc_id") -> DataFrame:
    """One row per file of ``weather_lines``: (loc_col, file, line, header, missing).

    ``line`` is the file's first line with any text, ``header`` its fields in lower case;
    ``missing`` names the columns of ``schema`` that it lacks.  Rows of a scan come in file
    order, so the first line is the one with the least row id of its file's first split.
    """
    first = lines.filter("start = 0").withColumn("id", F.monotonically_increasing_id())
    least = first.groupBy(loc_col, "file").agg(F.min(F.struct(F.trim("value") == "", "id", "value"))["value"].alias("line"))
    wanted = F.array(*[F.lit(f.name.lower()) for f in schema.fields])
    return (least.withColumn("header", F.transform(_fields(F.col("line")), F.lower))
            .withColumn("missing", F.array_except(wanted, "header")))


def weather_rows(lines: DataFrame, headers: DataFrame, schema: T.StructType = S.WEATHER_CSV,
                 loc_col: str = "loc_id", quarantine: bool = False) -> DataFrame:
    """Readings of the files that have every column, picked by header name.

    A field that does not fit its type is NULL; lines equal to their file's header are headers.
    ``quarantine=True`` adds the raw text of lines with too few or too many fields in
    ``_corrupt_record`` (NULL for good lines).  The headers, a row per file, are joined to
    the lines by file; Spark broadcasts them below its threshold.  Lines of a file outside any
    location's folder name theirs in the file's ``loc_col`` column, if it has one.
    """
    of = headers.filter(F.size("missing") == 0).select(F.col("file").alias("of_file"), "header", "line")
    rows = (lines.filter(F.trim("value") != "").join(of, F.col("file") == F.col("of_file")).filter("value <> line")
            .withColumn("fields", _fields(F.col("value"))))
    cols = [F.nullif(F.try_element_at("fields", F.array_position("header", f.name.lower()).cast("int")), F.lit(""))
            .try_cast(f.dataType).alias(f.name) for f in schema.fields]
    bad = [F.when(F.size("fields") != F.size("header"), F.col("value")).alias(CORRUPT)] if quarantine else []
    at = F.array_position("header", loc_col.lower()).cast("int")
    own = F.nullif(F.get("fields", at - 1), F.lit(""))
    return rows.select(*cols, *bad, F.when((F.col(loc_col) == "") & (at > 0), own).otherwise(F.col(loc_col)).alias(loc_col))


def weather_rejects(headers: DataFrame, loc_col: str = "loc_id") -> DataFrame:
    """The files that were left out: (loc_col, file, reason).  The others load."""
    return headers.filter(F.size("missing") > 0).select(
        loc_col, "file", F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")).alias("reason"))


def weather_files(reader, path: str | Sequence[str], schema: T.StructType = S.WEATHER_CSV,
                  loc_col: str = "loc_id") -> DataFrame:
    """The catalogue of landed weather exports, a row per file (``weather_headers``)."""
    return weather_headers(weather_lines(reader, path, loc_col), schema, loc_col)


def read_weather_csv(spark: SparkSession, path: str | Sequence[str],
                     schema: T.StructType = S.WEATHER_CSV, loc_col: str = "loc_id",
                     quarantine: bool = False) -> DataFrame:
    """Header CSV files below ``<path>/loc_id=<id>/``, all locations in one scan, and files of
    many locations with a column ``loc_id`` beside those folders.

    A location with no files, or only files that lack a column (``weather_rejects``),
    contributes no rows, and the others load.
    """
    lines = weather_lines(spark.read, path, loc_col)
    return weather_rows(lines, weather_headers(lines, schema, loc_col), schema, loc_col, quarantine)


def write_weather_csv(df: DataFrame, path: str, loc_col: str = "loc_id") -> None:
    """Land readings as header CSV per location (test fixture writer for S1/R1)."""
    (df.write.mode("append").partitionBy(loc_col).option("header", True).option("escape", '"').csv(path))


def write_weather_exports(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Land readings of many locations, named in a column, as header CSV files of at most
    ``rows_per_file``: files follow the readings and not the locations."""
    (df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("header", True)
     .option("escape", '"').csv(path))


# ---------------------------------------------------------------------------
# S3 parquet append, S7/S8 scans
# ---------------------------------------------------------------------------

def append_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                 partition_by: Sequence[str] = (), observe: bool = True) -> int | None:
    """S3: append a typed batch; returns the number of rows written."""
    out = conform(df, schema) if schema is not None else df
    obs = Observation("append") if observe else None
    if obs is not None:
        out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer = out.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return int(obs.get["rows"]) if obs is not None else None


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a fact table; projections and filters on the result reach the scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


# ---------------------------------------------------------------------------
# S4/S5 NDJSON
# ---------------------------------------------------------------------------

def to_ndjson_frame(df: DataFrame) -> DataFrame:
    """T3 at the JSON sink: dates as ``%Y-%m-%d``, timestamps as ``%Y-%m-%d %H:%M:%S``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(date_text(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(timestamp_text(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def append_ndjson(df: DataFrame, path: str) -> int:
    """Append rows as newline-delimited JSON; returns rows written."""
    obs = Observation("ndjson")
    (to_ndjson_frame(df).observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.mode("append").option("ignoreNullFields", False).json(path))
    return int(obs.get["rows"])


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType,
                mode: str = "FAILFAST") -> DataFrame:
    """Read NDJSON with a fixed schema, no inference.

    ``FAILFAST`` (the schema-enforced load) fails the job on the first row
    that does not fit; ``PERMISSIVE`` keeps it with NULL fields.
    """
    return (spark.read.schema(schema).option("mode", mode)
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]")
            .option("dateFormat", "yyyy-MM-dd").json(path))


# ---------------------------------------------------------------------------
# S6 row insert with per-row errors
# ---------------------------------------------------------------------------

def split_json_rows(texts: DataFrame, schema: T.StructType, text_col: str = "json",
                    keep: Sequence[str] = (), required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Parse JSON text rows against ``schema``; return (accepted, rejected).

    A row is rejected when its text is not a JSON object, a field does not fit its type or a
    ``required`` column is NULL; the rejected frame keeps the raw text and a reason.
    """
    parsed = parse_json_rows(texts, schema, text_col, keep)
    lacks = F.array_join(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required], F.lit(None).cast("string")), ", ")
    parsed = parsed.withColumn("reason", F.when(~F.col("accepted"), F.lit("row does not match table schema"))
                               .when(lacks != "", F.concat(F.lit("NULL in required column "), lacks)))
    accepted = parsed.filter("reason is null").select(*keep, *[f.name for f in schema.fields])
    rejected = parsed.filter("reason is not null").select(*keep, "raw", "reason")
    return accepted, rejected


def parse_json_rows(texts: DataFrame, schema: T.StructType, text_col: str = "json",
                    keep: Sequence[str] = ()) -> DataFrame:
    """Every JSON text row with its fields, its raw text and whether it is accepted."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = texts.select(*keep, F.col(text_col).alias("_raw"), F.from_json(
        F.col(text_col), with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
         "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}).alias("_r"))
    bad = F.col("_raw").isNull() | F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    return parsed.select(*keep, F.col("_raw").alias("raw"), (~bad).alias("accepted"),
                         *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])


def insert_rows(texts: DataFrame, schema: T.StructType, table_path: str, rejects_path: str,
                text_col: str = "json") -> tuple[int, int]:
    """Accepted rows appended to the table, rejected ones to a reject table.

    Returns (accepted, rejected) counts; ``rejected == 0`` is success.
    """
    staged_path = scratch_path(texts.sparkSession, "insert")  # parsed once, appended from there
    parse_json_rows(texts, schema, text_col).write.parquet(staged_path)
    staged = texts.sparkSession.read.parquet(staged_path)
    n_good = append_table(staged.filter("accepted"), table_path, schema)
    n_bad = append_table(staged.filter("not accepted").select("raw", F.lit(
        "row does not match table schema").alias("reason")), rejects_path)
    return n_good or 0, n_bad or 0


# ---------------------------------------------------------------------------
# S9/S10 catalog tables, S13 load report
# ---------------------------------------------------------------------------

def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)


def create_tables(spark: SparkSession, db: str, location: str | None = None,
                  tables: dict[str, T.StructType] | None = None,
                  partition_by: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS`` for the fact and dimension tables.

    Columns that are not nullable are NOT NULL in the DDL and checked by ``conform``;
    ``partition_by`` names a table's partition columns.
    """
    tables = tables or S.TABLE_SCHEMAS
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    out = []
    for name, schema in tables.items():
        loc = f" LOCATION '{location.rstrip('/')}/{name}'" if location else ""
        existed = spark.catalog.tableExists(f"{db}.{name}")
        parts = (partition_by or {}).get(name, ())
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} ({_ddl(schema)}) USING parquet{by}{loc}")
        out.append((name, "exists" if existed else "created"))
    return spark.createDataFrame(out, "name string, outcome string")


def drop_tables(spark: SparkSession, names: Sequence[str], db: str) -> DataFrame:
    """Drop each table if present; a missing table is not an error.

    Returns one outcome row per table: dropped, absent, or the error text.
    """
    out = []
    for name in names:
        full = f"{db}.{name}"
        try:
            existed = spark.catalog.tableExists(full)
            spark.sql(f"DROP TABLE IF EXISTS {full}")
            out.append((name, "dropped" if existed else "absent"))
        except Exception as e:  # noqa: BLE001 - reported per table, as the original does
            out.append((name, f"error: {e}"))
    return spark.createDataFrame(out, "name string, outcome string")


def load_report(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """Rows per key in a batch."""
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
