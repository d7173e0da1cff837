"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's target divided by its size is the number of copies expected of each of its
documents.  Documents of a source are ordered by size; the running sum of expected copies
plus one random offset per source is cut at the integers, and a document is emitted once
for each integer boundary it crosses.  Ordering by size spreads the sample over long and
short documents, so a source's taken words miss its target by about one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import free_name, keyed, prepare, stored
from portrisk.llm.running import running

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 9
#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of ``sizes`` (source, size): (source, n_docs, source_size, first_doc,
    target).

    Sources in code-point order, null last, take ``weights`` in turn and share the sum of all
    sizes; no target exceeds ``cap`` times its source's size, and what that leaves over is
    shared again by weight.  In order of capped size per weight the capped sources come
    first, so running sums find them in one pass.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    named = running(per, [F.col("source").asc_nulls_last()],
                    {"place": F.lit(1), "first_doc": F.col("n_docs")}, "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    named = stored(named.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size")), "weights")
    all_ = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    filled = running(named, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()],
                     {"weight_before": F.col("weight"), "most_before": F.col("most")}, "filled")
    full = (F.col("most").cast("double") * (F.lit(all_["weight"]) - F.col("weight_before")).cast("double")
            < F.col("weight").cast("double") * (F.lit(all_["size"]) - F.col("most_before")).cast("double"))
    filled = stored(filled.withColumn("full", full), "targets")
    held = filled.filter("full").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("most"),
                                     F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    share = ((F.col("weight") * (F.lit(all_["size"]) - F.lit(held["most"]))).cast("double")
             / (F.lit(all_["weight"]) - F.lit(held["weight"])).cast("double"))
    return filled.select("source", "n_docs", "source_size", "first_doc",
                         F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: (id, source, size, source_size, target, copies).

    A null text has size 0, a null source is a source of its own, repeated rows are sampled
    one by one, a source without words has target 0; an empty table gives an empty table;
    other columns are ignored.
    """
    prepare(docs.sparkSession)
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                               n_words(F.col(text_col).cast("string")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, cap)
    placed = running(sizes, [F.col("source").asc_nulls_last(), F.col("size"), F.col("id").asc_nulls_last()],
                     {"place": F.lit(1)}, "placed")
    of = targets.select(F.col("source").alias("of"), "source_size", "first_doc", "target")
    at = F.col("place") - F.col("first_doc")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cut = lambda k: F.floor(k.cast("double") * rate + offset(F.col("source"), seed))
    return (placed.join(of, F.col("source").eqNullSafe(F.col("of")))
            .select("id", "source", "size", "source_size", "target",
                    F.least(cut(at + 1) - cut(at), F.lit(cap)).alias("copies")))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is emitted, columns unchanged.

    Nulls, ties and repeated rows as in ``mix_plan``: rows with a null or repeated id are
    sampled one by one under keys of their own; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows, key = keyed(docs, id_col)
    of, times, nth = (free_name(rows, c) for c in ("mix_of", "mix_times", "mix_nth"))
    plan = stored(mix_plan(rows, weights, cap, seed, key, text_col, source_col).filter("copies > 0")
                  .select(F.col("id").alias(of), F.col("copies").alias(times)), "mix")
    # the plan is as long as the documents, so both sides are shuffled, whatever their size now
    return (rows.join(plan.hint("shuffle_hash"), F.col(key) == F.col(of))
            .withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM d GROUP BY source),
w AS (SELECT *, ({list(WEIGHTS)})[(place - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight, {CAP} * source_size AS most FROM s),
t AS (SELECT *, sum(source_size) OVER ()::BIGINT AS sum_size, sum(weight) OVER ()::BIGINT AS sum_weight,
             coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before,
             coalesce(sum(most) OVER before, 0)::BIGINT AS most_before
      FROM w WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most::DOUBLE * (sum_weight - weight_before)::DOUBLE
                < weight::DOUBLE * (sum_size - most_before)::DOUBLE AS held FROM t),
g AS (SELECT source, source_size, CASE WHEN held THEN most::DOUBLE ELSE
             (weight * (sum_size - coalesce((SELECT sum(most) FROM f WHERE held), 0)::BIGINT))::DOUBLE
             / (sum_weight - coalesce((SELECT sum(weight) FROM f WHERE held), 0)::BIGINT)::DOUBLE END AS target,
             ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM f),
r AS (SELECT d.*, source_size, target, u,
             CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS k
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * least(floor(k::DOUBLE * rate + u)::BIGINT - floor((k - 1)::DOUBLE * rate + u)::BIGINT, {CAP}) AS taken
FROM r
"""
