"""The hourly ingestion cycle (B1): weather -> line-up -> contingencies.

Each step is one distributed read-transform-append job over the landed files
of the run.  Outcomes are reported per step: a failing weather or news source
is reported and the cycle goes on; a line-up whose headers miss a required
column stops the cycle, as the original worker does (the remaining steps are
reported as not run).  Rows written are counted on the write itself.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.contingency import Rules, score_contingencies
from ..operators.ingest import ColumnMappingError, lineup_from_pages, normalize_weather
from ..sources.files import append_table, conform, insert_rows, read_weather_csv
from ..sources.html import HEADER_ERROR

STEPS = ("weather", "lineup", "contingencies")


def _fail_text(e: Exception) -> str:
    return f"error: {type(e).__name__}: {e}"


def _schema_error(e: Exception) -> bool:
    """Was it a line-up's headers?  Raised while planning, or by a page in a task."""
    return isinstance(e, ColumnMappingError) or HEADER_ERROR in str(e)


def _by_day(df: DataFrame, time_col: str) -> DataFrame:
    """With the partition column of a fact table: the day of ``time_col``."""
    return df.withColumn("dia", F.to_date(time_col)).repartition("dia", F.pmod(F.xxhash64(*df.columns), F.lit(8)))


def _weather_step(spark: SparkSession, land: str, wh: str, run_ts) -> tuple[str, int, str]:
    # a missing or broken source is reported, the cycle goes on
    try:
        readings = normalize_weather(read_weather_csv(spark, f"{land}/weather"), run_ts=run_ts)
        n = append_table(_by_day(conform(readings, S.FATO_CLIMA), "timestamp_leitura"), f"{wh}/fato_clima",
                         partition_by=["dia"])
        return ("weather", n or 0, "ok")
    except Exception as e:  # noqa: BLE001 - reported per step
        return ("weather", 0, _fail_text(e))


def run_cycle(spark: SparkSession, landing: str, warehouse: str, run_ts,
              rules: Rules = Rules()) -> DataFrame:
    """B1: run the three steps on ``landing/{weather,lineup,news}``.

    Landing layout: ``weather/loc_id=<id>/*.csv`` or ``weather/*.csv`` with a column
    ``loc_id`` (S1), ``lineup/`` and ``news/`` parquet pages (``page_id, batch_id, kind, html``).  Tables are
    appended under ``warehouse``, the weather and line-up facts by day (``dia``).
    Returns ``(step, rows, outcome)``.

    The weather step does not depend on the others, so its job runs
    concurrently with the line-up step (Spark schedules jobs from several
    driver threads); the contingency step waits for the line-up outcome.
    """
    land = landing.rstrip("/")
    wh = warehouse.rstrip("/")
    out: list[tuple[str, int, str]] = []
    stop = False

    with ThreadPoolExecutor(max_workers=1) as pool:
        weather = pool.submit(_weather_step, spark, land, wh, run_ts)

        # line-up: header problems stop the cycle (strict projection)
        try:
            pages = spark.read.schema(S.PAGES).parquet(f"{land}/lineup")
            rows = lineup_from_pages(pages, run_ts, strict=True)
            n = append_table(_by_day(conform(rows, S.FATO_LINEUP), "inserido_em"), f"{wh}/fato_lineup",
                             partition_by=["dia"])
            lineup = ("lineup", n or 0, "ok")
        except Exception as e:  # noqa: BLE001
            lineup = ("lineup", 0, _fail_text(e))
            stop = _schema_error(e)

        # contingencies: scored rows go through the row insert with rejects
        if stop:
            news = ("contingencies", 0, "not run: line-up schema error")
        else:
            try:
                pages = spark.read.schema(S.PAGES).parquet(f"{land}/news")
                scored = score_contingencies(pages, run_ts, rules)
                texts = scored.select(F.to_json(F.struct(*[c for c in scored.columns
                                                           if c in S.FATO_CONTINGENCIAS.fieldNames()]),
                                                {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))
                good, bad = insert_rows(texts, S.FATO_CONTINGENCIAS, f"{wh}/fato_contingencias_nlp",
                                        f"{wh}/fato_contingencias_nlp_rejects")
                news = ("contingencies", good, "ok" if bad == 0 else f"{bad} rows rejected")
            except Exception as e:  # noqa: BLE001
                news = ("contingencies", 0, _fail_text(e))
        out = [weather.result(), lineup, news]

    return spark.createDataFrame([(s, int(n), o) for s, n, o in out],
                                 "step string, rows bigint, outcome string")
