"""Importance resampling of documents toward a target distribution.

A pre-tokeniser's untrained Split over the ASCII-lowered text gives words with their offsets.
Runs of 1 to 3 words are windows, each a pair of the first word's start and the last word's
end; a window's bytes go to a bucket by their CRC-32.  Bucket counts of all documents and of
the target are two histograms of fixed length; a bucket's gain is the logarithm of its share
in the target over its share in the documents, a document's weight the sum of its windows'
gains.  Gumbel noise from the id's hash turns the highest scores into a draw without
replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from portrisk.llm.common import free_name, keyed, prepare, stored
from portrisk.llm.running import running

DIMS = 10_000
ORDERS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Code points that part words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Code points of a text tokenised at once; pieces end between words.
PIECE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BETWEEN = re.compile(BETWEEN)
_CUT = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # before lower-casing


@lru_cache(maxsize=1)
def _splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(BETWEEN), "removed")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PIECE
        cut = _CUT.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def windows(text: str | None, orders: int = ORDERS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of every window that ends in them), piece by piece over the whole text.

    Words are lower-cased (A-Z only); a window's bytes are its words joined by one space.
    The last words of a piece are carried into the next one, so windows cross its end.
    """
    carried = ""
    for piece in _pieces(text or ""):
        low = piece.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        flat = _BETWEEN.sub(" ", carried + low)  # one space between words, so that offsets are the windows'
        spans = [span for _, span in _splitter().pre_tokenize_str(flat)]
        old = carried.count(" ")
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        if flat.isascii():
            data = flat.encode()
            found = [crc32(data[a:b]) for k in range(orders)
                     for a, b in zip(starts[max(old - k, 0):], ends[max(old, k):])]
        else:
            found = [crc32(flat[a:b].encode("utf-8", "surrogatepass")) for k in range(orders)
                     for a, b in zip(starts[max(old - k, 0):], ends[max(old, k):])]
        yield len(spans) - old, np.array(found, np.int64)
        keep = spans[max(len(spans) - orders + 1, 0):] if orders > 1 else []
        carried = flat[keep[0][0]:keep[-1][1]] + " " if keep else ""


def _width(dims: int) -> str:
    return "<u2" if dims <= 1 << 16 else "<u4"


def features(rows: DataFrame, id_col: str | None, text_col: str = "text", dims: int = DIMS,
             orders: int = ORDERS) -> DataFrame:
    """The written table (id, n_words, n_features, buckets) of all rows, tokenised once.

    ``buckets`` are the buckets of a text's windows, packed as little-endian unsigned integers
    of 16 bits (of 32 for more than 65,536 buckets).  Null texts have no window.
    """
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                got = list(windows(text, orders))
                packed = b"".join((found % dims).astype(_width(dims)).tobytes() for _, found in got)
                out.append((sum(n for n, _ in got), sum(len(found) for _, found in got), packed))
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)),
                                   pa.array([r[2] for r in out], pa.binary())],
                                  names=["id", "n_words", "n_features", "buckets"])
    id_ = F.lit(None) if id_col is None else F.col(id_col)
    return stored(rows.select(id_.cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, n_words long, n_features long, buckets binary"), "features")


def histogram(table: DataFrame, dims: int = DIMS) -> DataFrame:
    """(bucket, n): windows of all rows of ``features`` by bucket, buckets without any left out.

    Each task counts its own rows and sends ``dims`` numbers at most; an empty table gives an
    empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(dims, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(packed, _width(dims)), minlength=dims)
        at = np.nonzero(counts)[0]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])
    return table.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, dims: int = DIMS) -> DataFrame:
    """(bucket, gain) for all ``dims`` buckets from the histograms of documents and target:
    a thousand times the logarithm of the smoothed shares' quotient, rounded down."""
    both = (raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .union(target.select("bucket", F.lit(0).cast("long"), "n"))
            .union(raw.sparkSession.range(dims).select(F.col("id").cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long"))))
    per = stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    sums = per.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    num = (F.col("t") + 1).cast("double") * F.lit(float(sums["s"] + dims))
    den = (F.col("s") + 1).cast("double") * F.lit(float(sums["t"] + dims))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(num / den)).alias("gain"))


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(table: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight) for every row of ``features``; no windows weigh 0."""
    dims = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(gain, np.int64)
        for b in batches:
            weight = [int(of[np.frombuffer(packed, _width(dims))].sum()) for packed in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns[:3], pa.array(weight, pa.int64())],
                                  names=["id", "n_words", "n_features", "weight"])
    return table.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           target_col: str = "text", dims: int = DIMS, orders: int = ORDERS, least_words: int = LEAST_WORDS,
           percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_features, weight, score, rank).

    ``rank`` counts the drawn rows from 1 in order of score, ties to the smaller id; it is
    null for rows with fewer than ``least_words`` words and for rows not drawn.  Null texts
    have no words; a null id comes after all others; rows that repeat an id are rows of their
    own with the same noise; an empty target counts as a target without windows; an empty
    table of documents gives an empty table; other columns are ignored.  Texts are tokenised
    once and their buckets written (about the size of the texts), because tokenising costs
    far more than reading them again; only the ``dims`` gains pass through the driver; ranks
    come from sums over ranges of scores.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = features(docs, id_col, text_col, dims, orders)
    aim = features(target, None, target_col, dims, orders)
    gain = [r["gain"] for r in gains(histogram(table, dims), histogram(aim, dims), dims).orderBy("bucket").collect()]
    found = stored(weights(table, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    fit = found.filter(F.col("n_words") >= least_words)
    most = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    placed = running(fit, order, {"place": F.lit(1).cast("long")}, "ranks")
    columns = ["id", "n_words", "n_features", "weight", "score"]
    drawn = placed.select(*columns, F.when(F.col("place") < most, F.col("place") + 1).alias("rank"))
    return drawn.union(found.filter(F.col("n_words") < least_words)
                       .select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              target_col: str = "text", **settings: int) -> DataFrame:
    """The drawn rows of ``docs`` themselves, columns unchanged; settings as for ``ranked``.

    Rows that repeat an id are drawn one by one, each with a key of its own for its noise.
    """
    rows, key = keyed(docs, id_col)
    of = free_name(rows, "drawn_key")
    drawn = ranked(rows, target, key, text_col, target_col, **settings).filter("rank is not null")
    return rows.join(stored(drawn.select(F.col("id").alias(of)), "drawn"), F.col(key) == F.col(of), "left_semi")


SQL = rf"""
WITH crc AS (SELECT list(list_reduce(range(0, 9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1
                         THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc FROM range(256) t(i)),
w AS MATERIALIZED (SELECT 'd' AS kind, row_number() OVER () AS k, doc_id, text FROM documents
      UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
v AS (SELECT kind, k, doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM w),
f AS (SELECT kind, k, unnest(flatten(list_transform(range(0, {ORDERS}), lambda n: list_transform(
             range(1, len(words) - n + 1), lambda i: array_to_string(words[i:i + n], ' '))))) AS feature FROM v),
c AS (SELECT kind, k, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM c)),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2),
             lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])),
             4294967295) % {DIMS} AS bucket FROM h, crc),
p AS (SELECT kind, k, bucket, sum(n) AS n FROM c JOIN b USING (feature) GROUP BY ALL),
q AS (SELECT i AS bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t
      FROM range({DIMS}) r(i) LEFT JOIN p ON bucket = i GROUP BY i),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((sum(s) OVER ()) + {DIMS})::DOUBLE)
                          / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + {DIMS})::DOUBLE)))::BIGINT AS gain FROM q),
x AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
      FROM p JOIN g USING (bucket) WHERE kind = 'd' GROUP BY k),
y AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM v LEFT JOIN x USING (k) WHERE kind = 'd'),
z AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score,
             n_words >= {LEAST_WORDS} AS fit FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place,
             count(*) OVER (PARTITION BY fit) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM r
"""
