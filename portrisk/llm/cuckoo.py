"""Exact deduplication over a cuckoo-filter index.

The index keeps the live digests of one bucket: a cuckoo filter of 16-bit tags in front of
the stored keys.  A lookup the filter denies is certain; one it admits is verified against
the stored keys.  When an insertion finds no place, the filter is rebuilt twice as large
from the stored keys.  Digests are dealt into buckets by their own bits; each map task first
folds its own repeats, so that a text with very many copies reaches its bucket once a task.
Groups of equal digests are then verified against the texts themselves.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import drop_rows, keyed, per_batch, prepare, stored

SLOTS = 4
MAX_KICKS = 200
#: Digests a bucket is meant to hold; the number of buckets follows the number of rows.
BUCKET_ROWS = 20_000
#: Digests a map task folds before it passes them on.
FOLD_ROWS = 200_000
#: Bytes of text a map task keeps to fold repeated texts.
FOLD_BYTES = 32 << 20


class CuckooIndex:
    """Live digests with insertion, deletion and exact lookup; value: anything kept by digest."""

    def __init__(self, capacity: int = 1024) -> None:
        self.stored: dict[bytes, object] = {}
        self.resizes = 0
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        n = 4
        while n * SLOTS * 0.9 < capacity:
            n *= 2
        self._mask = n - 1
        self._table = array("H", bytes(2 * n * SLOTS))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh64_intdigest(digest)
        tag = (h >> 40 & 0xFFFF) or 1
        i = h & self._mask
        return tag, i, i ^ (tag * 0x5BD1 & self._mask)

    def may_contain(self, digest: bytes) -> bool:
        tag, i, j = self._places(digest)
        t = self._table
        return tag in t[i * SLOTS:i * SLOTS + SLOTS] or tag in t[j * SLOTS:j * SLOTS + SLOTS]

    def get(self, digest: bytes):
        """The value of a live digest, or None: filter first, then the stored keys."""
        return self.stored.get(digest) if self.may_contain(digest) else None

    def insert(self, digest: bytes, value: object) -> None:
        """Add a digest, or replace the value of a live one."""
        if self.get(digest) is not None:
            self.delete(digest)
        self.stored[digest] = value
        if not self._place(digest):
            self.resize()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not in the index."""
        if digest not in self.stored:
            return False
        del self.stored[digest]
        tag, i, j = self._places(digest)
        for at in (i, j):
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if self._table[s] == tag:
                    self._table[s] = 0
                    return True
        raise AssertionError("a live digest has no tag")

    def resize(self) -> None:
        """A filter twice as large, filled from the stored keys."""
        while True:
            self.resizes += 1
            self._clear(2 * (self._mask + 1) * SLOTS)
            if all(self._place(d) for d in self.stored):
                return

    def _place(self, digest: bytes) -> bool:
        tag, i, j = self._places(digest)
        t = self._table
        for at in (i, j):
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        at = i
        for kick in range(MAX_KICKS):  # move a tag to its other place
            s = at * SLOTS + kick % SLOTS
            tag, t[s] = t[s], tag
            at ^= tag * 0x5BD1 & self._mask
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        return False

    def fold(self, digest: bytes, holder: tuple, n: int) -> None:
        """Count ``n`` rows of a digest; the greatest holder stays live."""
        old = self.get(digest)
        if old is None:
            self.insert(digest, (holder, n))
        elif holder > old[0]:
            self.delete(digest)
            self.insert(digest, (holder, old[1] + n))
        else:
            self.stored[digest] = (old[0], old[1] + n)


def normalised(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and nothing else; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary) for every row: SHA-256 of the normalised text."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [hashlib.sha256(normalised(t)).digest() for t in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(got, pa.binary())], names=["id", "digest"])
    return per_batch(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")),
                     run, "id long, digest binary")


#: Sorts below every id: the holder of a row whose id is null.
_NO_ID = -(1 << 63)


def _folded(rows: DataFrame, digest_bytes: int) -> DataFrame:
    """One row per digest and map task (more if the task has very many): (digest, id, row, n)."""
    def emit(index: CuckooIndex) -> pa.RecordBatch:
        held = list(index.stored.items())
        return pa.record_batch([pa.array([d for d, _ in held], pa.binary()),
                                pa.array([v[0][0] for _, v in held], pa.int64()),
                                pa.array([v[0][1] for _, v in held], pa.int64()),
                                pa.array([v[1] for _, v in held], pa.int64())], names=["key", "id", "row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            for i, d, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                index.fold(d[:digest_bytes], (_NO_ID if i is None else i, r), 1)
            if len(index.stored) >= FOLD_ROWS:
                yield emit(index)
                index = CuckooIndex()
        yield emit(index)
    return rows.select("id", "digest", "row").mapInArrow(run, "key binary, id long, row long, n long")


def live_index(rows: DataFrame, digest_bytes: int = 32, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index's live entries: (key, keep_id, keep_row, group_size), one row per digest.

    ``rows``: (id, digest, row).  Of a digest's rows the greatest (id, row) is the holder; rows
    that repeat an id, a row or all of them count one by one; texts of any length are digests
    here; no rows give an empty table.
    """
    buckets = max(1, -(-rows.count() // bucket_rows))

    def bucket(g: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(g))
        for d, i, r, n in zip(g["key"], g["id"], g["row"], g["n"]):
            index.fold(bytes(d), (i, r), n)
        return _entries(index)

    parts = _folded(rows, digest_bytes).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return parts.groupBy("bucket").applyInPandas(bucket, "key binary, keep_id long, keep_row long, group_size long")


def updated_index(live: DataFrame, added: DataFrame, removed: DataFrame, digest_bytes: int = 32,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The entries of ``live`` (rows of ``live_index``) after a batch: first the digests of
    ``removed`` (digest) are deleted, then the rows ``added`` (id, digest, row) are inserted.

    Each bucket's filter is rebuilt from its stored keys.  Digests that are not live are
    removed without effect; tables may be empty; a null id is least.
    """
    folded = _folded(added, digest_bytes)
    gone = removed.select(F.substring("digest", 1, digest_bytes).alias("key")).distinct()
    parts = (live.select("key", F.col("keep_id").alias("id"), F.col("keep_row").alias("row"),
                         F.col("group_size").alias("n"), F.lit(0).alias("step"))
             .unionByName(gone.select("key", *[F.lit(0).cast("long").alias(c) for c in ("id", "row", "n")], F.lit(1).alias("step")))
             .unionByName(folded.withColumn("step", F.lit(2))))
    buckets = max(1, -(-(live.count() + added.count()) // bucket_rows))

    def bucket(g: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(g))
        for step, d, i, r, n in g.sort_values("step", kind="stable")[["step", "key", "id", "row", "n"]].itertuples(index=False):
            if step == 1:
                index.delete(bytes(d))
            else:
                index.fold(bytes(d), (i, r), n)
        return _entries(index)
    return (parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(bucket, "key binary, keep_id long, keep_row long, group_size long"))


def _entries(index: CuckooIndex) -> pd.DataFrame:
    live = list(index.stored.items())
    return pd.DataFrame({"key": [d for d, _ in live], "keep_id": [v[0][0] for _, v in live],
                         "keep_row": [v[0][1] for _, v in live], "group_size": [v[1] for _, v in live]})


#: Bits of the map of shared digests that every task holds (8 MB), whatever their number.
FILTER_BITS = 26


def shared_bits(shared: DataFrame, digest_bytes: int) -> np.ndarray:
    """A map with the first bits of every digest in ``shared`` (key), as 64-bit words.

    Digests are uniform, so a text that is no copy passes with a chance of about their number
    over 2^FILTER_BITS.  The map's size is fixed; when the digests outgrow it, it lets more
    texts pass and is still right.
    """
    bits = min(FILTER_BITS, 8 * digest_bytes)
    head = F.conv(F.rpad(F.hex(F.substring("key", 1, 4)), 8, "0"), 16, 10).cast("long")
    places = shared.select(F.shiftright(head, 32 - bits).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    found = np.zeros(max(1, (1 << bits) // 64), np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def _texts(docs: DataFrame, text_col: str, shared: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest, body): the normalised texts whose digests may be in ``shared``, each once a map
    task as far as it can tell.

    Texts are left out whose digests are surely not shared, and those found byte for byte
    equal to one passed on before.
    """
    held = docs.sparkSession.sparkContext.broadcast(shared_bits(shared, digest_bytes))
    shift = 32 - min(FILTER_BITS, 8 * digest_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        room, words = FOLD_BYTES, held.value
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                body = normalised(t)
                d = hashlib.sha256(body).digest()
                place = int.from_bytes(d[:4], "big") >> shift
                if not int(words[place >> 6]) >> (place & 63) & 1 or seen.get(d) == body:
                    continue
                if d not in seen and len(body) <= room:
                    seen[d] = body
                    room -= len(body)
                out.append((d, body))
            yield pa.record_batch([pa.array([d for d, _ in out], pa.binary()),
                                   pa.array([x for _, x in out], pa.binary())], names=["digest", "body"])
    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "digest binary, body binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: (id, digest, keep_id, group_size, kept).

    Texts are equal when identical after lower-casing A-Z (null: empty).  Of equal texts the
    row with the greatest id stays, a null id being least; of repeated rows (same id, same
    text) one.  Groups are found by the first ``digest_bytes`` of the digest and verified
    against the texts; a digest shared by different texts is grouped again by the text itself.
    Empty table: empty result.  Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = stored(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    live = stored(live_index(rows, digest_bytes), "live")
    key = F.substring("digest", 1, digest_bytes)
    # content of the digests with several rows: equal to the first and the last text or not
    shared = live.filter("group_size > 1").select("key")
    content = (_texts(docs, text_col, shared, digest_bytes).withColumn("key", key).join(shared.hint("shuffle_hash"), "key", "left_semi")
               .groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high")))
    clash = stored(content.filter("low <> high").select("key"), "clashes")
    found = rows.withColumn("key", key).join(live, "key")
    out = ["id", "digest", "keep_id", "keep_row", "group_size", "row"]
    if not clash.isEmpty():
        fine = found.join(clash, "key", "left_anti").select(*out)
        def bodies(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [normalised(t) for t in b.column(1).to_pylist()]
            return pa.record_batch([b.column(0), pa.array([hashlib.sha256(x).digest() for x in got], pa.binary()),
                                    pa.array(got, pa.binary())], names=["id", "digest", "body"])
        again = stored(per_batch(docs.select(F.col(id_col).cast("long").alias("id"),
                                             F.col(text_col).cast("string").alias("t")),
                                 bodies, "id long, digest binary, body binary")
                       .withColumn("key", key).join(clash, "key", "left_semi")
                       .withColumn("row", F.monotonically_increasing_id()), "clashing")
        whole = (again.groupBy("body")
                 .agg(F.max(F.struct(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "row")).alias("k"),
                      F.count(F.lit(1)).alias("group_size"))
                 .select("body", F.col("k.id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size"))
        found = fine.unionByName(again.join(whole, "body").select(*out))
    return found.select("id", "digest", F.nullif("keep_id", F.lit(_NO_ID)).alias("keep_id"), "group_size",
                        (F.col("row") == F.col("keep_row")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep, columns unchanged.

    Null texts count as empty and are equal to empty ones; a null id is less than any other; of
    rows alike in id and text one stays; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows, key = keyed(docs, id_col)
    tied = exact_groups(rows, key, text_col)
    if key != id_col:  # ids are null or repeat: the greatest id first, then the row number
        order = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.col(key))
        groups = tied.select(F.col("id").alias("of"), "digest")
        best = (rows.select(key, order.alias("rank")).join(groups, F.col(key) == F.col("of"))
                .groupBy("digest").agg(F.max("rank").alias("best")))
        keep = best.select(F.col("best")[key].alias("of"))
        tied = groups.select(F.col("of").alias("id")).join(keep.withColumn("kept", F.lit(True)),
                                                           F.col("id") == F.col("of"), "left").select(
            "id", F.coalesce("kept", F.lit(False)).alias("kept"))
    gone = tied.filter(~F.col("kept")).select(F.col("id").alias(key))
    return drop_rows(rows, key, gone).select(*docs.columns)


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM n WINDOW same AS (PARTITION BY body)
"""
