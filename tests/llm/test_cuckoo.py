import hashlib
import random

import pytest

from portrisk.llm import cuckoo

UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def test_index_inserts_deletes_and_resizes():
    rng = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(6000)]
    index, live = cuckoo.CuckooIndex(64), {}
    for step in range(20000):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(k) == (k in live)
            live.pop(k, None)
        else:
            index.insert(k, step)
            live[k] = step
        if step % 500 == 0:
            assert all(index.get(x) == live.get(x) for x in keys)
    assert index.resizes > 0 and index.stored == live
    assert all(index.may_contain(k) for k in live)
    false_hits = sum(index.may_contain(hashlib.sha256(b"x%d" % i).digest()) for i in range(5000))
    assert false_hits < 50


def brute(rows):
    norm = [(r[1] or "").translate(UPPER) for r in rows]
    size, keep = {}, {}
    for r, t in zip(rows, norm):
        size[t] = size.get(t, 0) + 1
        if t not in keep or keep[t] is None or (r[0] is not None and r[0] > keep[t]):
            keep[t] = r[0]
    return sorted((str(r[0]), hashlib.sha256(t.encode()).hexdigest(), str(keep[t]), size[t]) for r, t in zip(rows, norm))


ROWS = [(1, "Same Text", "x"), (2, "sAME text", "y"), (3, "same text ", "z"), (4, None, "x"), (5, "", None),
        (None, "same text", "q"), (6, "ÄB", "k"), (7, "äb", "k"), (8, "long " * 300000, "k"), (9, "LONG " * 300000, "k"),
        (2, "same TEXT", "rep"), (10, "other", "a"), (10, "other", "a"), (None, "only null id", "n"),
        (None, "only null id", "n")] + [(100 + i, f"copy {'HOT' if i % 3 else i}", "h") for i in range(400)]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_equal_brute_force_also_when_digests_collide(spark, digest_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(6)
    got = cuckoo.exact_groups(docs, digest_bytes=digest_bytes).collect()
    assert sorted((str(r["id"]), bytes(r["digest"]).hex(), str(r["keep_id"]), r["group_size"]) for r in got) == brute(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({bytes(r["digest"]) for r in got}) and all(r["id"] == r["keep_id"] for r in kept)


def test_filter_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(6)
    for rows in (docs, docs.filter("doc_id > 2 and doc_id <> 10"), docs.limit(0)):
        out = cuckoo.deduplicated(rows)
        got = out.collect()
        want = {}
        for r in rows.collect():
            t = (r["text"] or "").translate(UPPER)
            want[t] = max(want.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
        assert out.columns == docs.columns and len(got) == len(want)
        assert {(r["text"] or "").translate(UPPER): -1 if r["doc_id"] is None else r["doc_id"] for r in got} == want
    assert cuckoo.exact_groups(docs.limit(0)).count() == 0


def test_index_takes_batches_and_deletions(spark):
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    table = lambda rows: spark.createDataFrame([(i, bytearray(digest(k)), i) for i, k in rows], "id long, digest binary, row long")
    first, later = [(i, i % 50) for i in range(300)], [(1000 + i, i % 70) for i in range(140)]
    live = cuckoo.live_index(table(first), bucket_rows=10)
    removed = spark.createDataFrame([(bytearray(digest(k)),) for k in [0, 1, 2, 999]], "digest binary")
    got = cuckoo.updated_index(live, table(later), removed, bucket_rows=10).collect()
    want = {}
    for i, k in [x for x in first if x[1] > 2] + later:
        keep, n = want.get(k, (-1, 0))
        want[k] = (max(keep, i), n + 1)
    assert {bytes(r["key"]): (r["keep_id"], r["group_size"]) for r in got} == {digest(k): v for k, v in want.items()}
    same = cuckoo.updated_index(live, table(later).limit(0), removed.limit(0)).collect()
    assert sorted(map(str, same)) == sorted(map(str, live.collect()))


def test_map_of_shared_digests_admits_all_of_them_and_few_others(spark):
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    for size in (1, 2, 32):
        held = {digest(k)[:size] for k in range(300)}
        shared = spark.createDataFrame([(bytearray(d),) for d in held], "key binary")
        words, shift = cuckoo.shared_bits(shared, size), 32 - min(cuckoo.FILTER_BITS, 8 * size)
        passes = lambda d: bool(int(words[(int.from_bytes(d[:4], "big") >> shift) >> 6]) >> ((int.from_bytes(d[:4], "big") >> shift) & 63) & 1)
        assert all(passes(digest(k)) for k in range(300))
        others = sum(passes(digest(k)) for k in range(300, 5300)) / 5000
        assert others <= len(held) / (1 << min(cuckoo.FILTER_BITS, 8 * size)) + 0.05
        assert len(words) * 8 <= 8 << 20
    assert not cuckoo.shared_bits(shared.limit(0), 32).any()
