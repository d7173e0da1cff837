"""Road/news access-risk scoring (X4, X5, X6 with A12-A14, P14, T5-T8).

A *batch* is one monitoring run: one or more road-status pages and news
pages.  Road pages score by tiers (first tier that matches wins); the first
N headlines of each news page score one weight each; the batch score is the
capped sum.  Every page is parsed in the executors, alerts are joined in ranges of their
order (so that one batch may hold any share of them), and a batch without any
alert still yields a row with score 0 and the default sentence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import contains_any, headline, json_key, row_hash_id
from ..functions.text import page_text
from ..session import scratch_path
from ..sources.html import page_elements


@dataclass(frozen=True)
class Rules:
    """X4 rule table; defaults are the original project's values."""
    road_tiers: Sequence[tuple[Sequence[str], float, str]] = (
        (tuple(S.ROAD_TIER_BLOCK), S.ROAD_BLOCK_WEIGHT, S.ROAD_BLOCK_TEXT),
        (tuple(S.ROAD_TIER_SLOW), S.ROAD_SLOW_WEIGHT, S.ROAD_SLOW_TEXT),
    )
    news_words: Sequence[str] = tuple(S.NEWS_STRIKE_WORDS)
    news_weight: float = S.NEWS_WEIGHT
    news_prefix: str = S.NEWS_PREFIX
    headline_chars: int = S.HEADLINE_CHARS
    headlines_per_page: int | None = S.HEADLINES_PER_PAGE
    link_tag: str = S.NEWS_LINK_TAG
    link_class: str | None = S.NEWS_LINK_CLASS
    default_text: str = S.NO_ALERT_TEXT
    cap: float = S.SCORE_CAP


def first_tier(text: Column, tiers: Sequence[tuple[Sequence[str], float, str]]) -> Column:
    """X4 for one text: struct(weight, message) of the first matching tier, else NULL."""
    out = None
    for words, weight, message in tiers:
        hit = F.struct(F.lit(float(weight)).alias("weight"), F.lit(message).alias("message"))
        cond = contains_any(text, words)
        out = F.when(cond, hit) if out is None else out.when(cond, hit)
    return out if out is not None else F.lit(None)


def road_alerts(road_pages: DataFrame, rules: Rules, batch_col: str = "batch_id") -> DataFrame:
    """X1 + X4 on road pages: (batch, page_id, ord, weight, message); NULL message = no alert."""
    # the page text is projected once; the tier rules then read the column
    texts = road_pages.select(batch_col, "page_id", page_text(F.col("html"), lower=True).alias("_t"))
    hits = texts.select(batch_col, "page_id", first_tier(F.col("_t"), rules.road_tiers).alias("_hit"))
    return hits.select(
        batch_col, F.lit(0).alias("src"), "page_id", F.lit(0).alias("ord"),
        F.coalesce(F.col("_hit.weight"), F.lit(0.0)).alias("weight"), F.col("_hit.message").alias("message"))


def news_alerts(news_pages: DataFrame, rules: Rules, batch_col: str = "batch_id") -> DataFrame:
    """X3 + E4 + X4 + T6 on news pages: each of the first N headlines with a word."""
    heads = page_elements(news_pages, rules.link_tag, rules.link_class,
                          limit=rules.headlines_per_page, keep=[batch_col])
    hit = contains_any(F.col("text"), rules.news_words)
    msg = F.concat(F.lit(rules.news_prefix), headline(F.col("text"), rules.headline_chars))
    # pages without any headline still mark their batch as present
    present = news_pages.select(batch_col, F.lit(1).alias("src"), "page_id",
                                F.lit(-1).alias("ord"), F.lit(0.0).alias("weight"),
                                F.lit(None).cast("string").alias("message"))
    found = heads.select(batch_col, F.lit(1).alias("src"), "page_id", "ord",
                         F.when(hit, F.lit(float(rules.news_weight))).otherwise(F.lit(0.0)).alias("weight"),
                         F.when(hit, msg).alias("message"))
    return present.unionByName(found)


def page_alerts(pages: DataFrame, rules: Rules = Rules(), batch_col: str = "batch_id",
                kind_col: str = "kind") -> DataFrame:
    """X4 on all pages: (batch, src, page_id, ord, weight, message), a row per hit and per page."""
    road = road_alerts(pages.filter(F.col(kind_col) == "road"), rules, batch_col)
    news = news_alerts(pages.filter(F.col(kind_col) == "news"), rules, batch_col)
    return road.unionByName(news)


def score_alerts(alerts: DataFrame, run_ts, rules: Rules = Rules(), region: str = S.CONTINGENCY_LOC,
                 entity: str = S.CONTINGENCY_ENTITY, batch_col: str = "batch_id") -> DataFrame:
    """X5 from ``page_alerts``: one ``fato_contingencias_nlp`` row per batch, a null batch too.

    ``alerts`` is read twice, by the sample that finds its ranges and by the shuffle into
    them, so it should be a written table.
    """
    msg = F.col("message")
    order = [F.col(c) for c in (batch_col, "src", "page_id", "ord", "message")]
    # ranges of the alerts' order: a batch of any size is joined range by range, then the ranges' texts
    ranged = alerts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    hits = F.array_sort(F.collect_list(F.when(msg.isNotNull(), F.struct("src", "page_id", "ord", "message"))))
    pieces = ranged.groupBy(batch_col, "_range").agg(
        F.sum("weight").alias("total"), F.count(msg).alias("n"),
        F.array_join(F.transform(hits, lambda h: h["message"]), S.TEXT_JOIN).alias("text"))
    texts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("_range", "text"))))
    per_batch = pieces.groupBy(batch_col).agg(
        F.sum("total").alias("total"), F.sum("n").cast("int").alias("n_alerts"),
        F.array_join(F.transform(texts, lambda t: t["text"]), S.TEXT_JOIN).alias("joined"))
    return per_batch.select(
        row_hash_id(F.lit(region), F.col(batch_col), F.lit(str(run_ts))).alias("cont_id"),
        F.lit(region).alias("loc_id"),
        F.lit(run_ts).cast("timestamp").alias("timestamp_leitura"),
        F.when(F.col("n_alerts") > 0, F.col("joined")).otherwise(F.lit(rules.default_text)).alias("texto_original"),
        F.lit(entity).alias("entidade_evento"),
        F.round(F.least(F.col("total"), F.lit(rules.cap)), 9).alias("score_risco"),
        F.to_json(F.struct(F.col("n_alerts").alias("alertas"))).alias("json_extraido"),
        F.col(batch_col),
    )


def score_contingencies(pages: DataFrame, run_ts, rules: Rules = Rules(),
                        region: str = S.CONTINGENCY_LOC, entity: str = S.CONTINGENCY_ENTITY,
                        batch_col: str = "batch_id", kind_col: str = "kind") -> DataFrame:
    """One ``fato_contingencias_nlp`` row per batch.

    ``pages`` has (batch_id, page_id, kind in {'road','news'}, html).  A
    missing source contributes nothing; the row is still written.
    Score = min(sum of weights, cap) rounded to 9 digits (sums of tenths);
    texts are joined by " | " in detection order (road first, then
    headlines in page order); ``json_extraido`` = ``{"alertas": n}``.
    """
    alerts = page_alerts(pages, rules, batch_col, kind_col)
    path = scratch_path(pages.sparkSession, "alerts")  # every page is parsed once
    alerts.write.parquet(path)
    alerts = pages.sparkSession.read.schema(alerts.schema).parquet(path)
    return score_alerts(alerts, run_ts, rules, region, entity, batch_col)


def contingency_from_json(df: DataFrame, json_col: str, text_col: str, run_ts,
                          id_keys: Sequence[str], score: float = S.JSON_DEFAULT_SCORE,
                          region: str = S.JSON_CONTINGENCY_LOC,
                          event_key: str = "evento", default: str = S.JSON_EVENT_DEFAULT) -> DataFrame:
    """Extracted-JSON rows -> contingency rows (fixed score, event key with default)."""
    return df.select(
        *id_keys,
        row_hash_id(*[F.col(k) for k in id_keys], F.lit(str(run_ts))).alias("cont_id"),
        F.lit(region).alias("loc_id"),
        F.lit(run_ts).cast("timestamp").alias("timestamp_leitura"),
        F.col(text_col).cast("string").alias("texto_original"),
        json_key(F.col(json_col), event_key, default).alias("entidade_evento"),
        F.lit(float(score)).alias("score_risco"),
        F.col(json_col).alias("json_extraido"),
    )


__all__ = ["Rules", "first_tier", "road_alerts", "news_alerts", "page_alerts", "score_alerts", "score_contingencies",
           "contingency_from_json"]
