import hashlib
import itertools
import random
import re
import zlib

import pytest

from portrisk.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, nth int"
SPACE = " \t\n\x0b\x0c\r"


def brute_rows(turns):
    """Rows of one conversation in order, with their faults."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, out = set(), []
    for t, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        fault = ("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def apply(rows, audit):
    """Cost and repaired turns of an audit; None if it doesn't fit the rows or the pattern."""
    edits = re.fullmatch("((?:I*[KRD])*)(I*)", audit)
    if not edits or len(re.sub("I", "", audit)) != len(rows):
        return None
    kept = len(audit) - audit.count("D")
    cost, out, at = 0, [], 0
    for e in audit:
        want = ("assistant" if (len(out) - kept % 2) % 2 else "user") if len(out) >= kept % 2 else "system"
        if e == "I":
            cost += 2
            if want == "system":
                return None
            out.append((want, ""))
            continue
        _, role, text, fault = rows[at]
        at += 1
        if e == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate") or (e == "K" and role[:1] != want[0]) or (e == "R" and want == "system"):
            return None
        cost += (2 if e == "R" else 0) + (fault == "truncated")
        out.append((role if e == "K" else want, text))
    if not re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
        return None
    return cost, out


def brute(turns, most=None):
    """The report of one conversation by trying every audit (short ones) of at most ``most`` letters."""
    rows = brute_rows(turns)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = [sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = min((got[0], "".join(a), got[1]) for n in range(len(rows), 2 * len(rows) + 2)
               for a in itertools.product("DIKR", repeat=n) if (got := apply(rows, "".join(a))))
    return gaps, *count, illegal, best[0], best[1], digest(best[2])


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def made(n, seed):
    rng = random.Random(seed)
    out, text = [], ["Fine.", "cut off", "Really?", "", " \t", "Fine. ", None, "Go!"]
    for _ in range(n):
        out.append((rng.choice([None, rng.randrange(6), rng.randrange(6)]),
                    rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"]), rng.choice(text)))
    return out


def reported(spark, data, tasks=3):
    rows = [(c, t, r, x, "k", 1) for c, turns in data.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(tasks)
    out = repair.report(frame, frame)
    assert out.columns == ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["id"]: tuple(r)[1:] for r in out.collect()}


def test_against_all_audits(spark):
    data = {k: made(k % 4 + 1, k) for k in range(60)} | {None: made(3, 99)}
    assert reported(spark, data) == {c: brute(turns) for c, turns in data.items()}


def long_brute(turns):
    """The same by keeping each state's least (cost, audit) row by row, as text."""
    rows = brute_rows(turns)
    step, at = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}, {0: (0, "")}
    for _, role, _, fault in rows:
        nxt = {}
        for s, (cost, audit) in at.items():
            found = [(s, cost + 3, audit + "D")]
            for n in range(3):
                if n:
                    found.append((s, cost + 2 * n + 3, audit + "I" * n + "D"))
                if fault not in ("blank", "duplicate"):
                    q, letter = step[s]
                    add = cost + 2 * n + (fault == "truncated")
                    if role[:1] == letter:
                        found.append((q, add, audit + "I" * n + "K"))
                    if role[:1] == "s" and s == 0:
                        found.append((1, add, audit + "I" * n + "K"))
                    found.append((q, add + 2, audit + "I" * n + "R"))
                s = step[s][0]
            for q, c, a in found:
                nxt[q] = min(nxt.get(q, (c, a)), (c, a))
        at = nxt
    cost, audit = min((c + 2 * len(end), a + end) for s, end in ((0, ""), (1, "II"), (2, "I"), (3, "")) if s in at
                      for c, a in [at[s]])
    assert apply(rows, audit)[0] == cost
    return cost, audit, digest(apply(rows, audit)[1])


@pytest.mark.parametrize("block,fan", [(1024, 256), (7, 3), (1, 2)])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    data = {1: made(400, 5), 2: made(2, 6), 3: made(31, 7), 4: [(k, ["user", "assistant"][k % 2], f"t{k}.") for k in range(150)]}
    got = reported(spark, data, 5)
    assert {c: v[5:] for c, v in got.items()} == {c: long_brute(turns) for c, turns in data.items()}
    assert got[4][:7] == (0, 0, 0, 0, 0, 0, "K" * 150)
    for c, turns in data.items():
        rows = brute_rows(turns)
        assert got[c][4] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 1, 2])
def test_strings_compare_right_under_forced_collisions(monkeypatch, prime):
    monkeypatch.setattr(repair, "PRIME", prime)
    rng, audits, texts = random.Random(1), repair.Audits(), {0: ""}
    for _ in range(300):
        node = rng.choice(list(texts))
        letter = rng.choice("DKI")
        texts[audits.append(node, ord(letter), 0)] = texts[node] + letter
    for _ in range(4000):
        a, b = rng.choice(list(texts)), rng.choice(list(texts))
        assert audits.less(a, b) == (texts[a] < texts[b])
    assert all("".join(map(chr, audits.read(n)[0])) == t for n, t in texts.items())
    rows = [repair.row_table(r, f, c) for r, f, c in rng.choices([("u", False, True), ("a", False, False), ("a", True, False)], k=60)]
    monkeypatch.setattr(repair, "PRIME", (1 << 61) - 1)
    want = repair.solve(rows, range(4))
    monkeypatch.setattr(repair, "PRIME", prime)
    assert repair.solve(rows, range(4)) == want


def test_damage(spark):
    rows = [(c, t, "assistant", "Is it. so!?", "k", 1) for c in range(40) for t in range(3)]
    rows += [(None, 1, None, None, "k", 1), (7, None, "user", None, "k", 1)]
    got = sorted(repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    want = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else text.translate({46: "", 33: "", 63: ""})
                      if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows if c is not None} >= set(range(5))


def test_empty_tables_and_lost_conversations(spark):
    ids = spark.createDataFrame([(1, 1, "user", "x", "k", 1), (2, 1, "user", "x", "k", 1)], SCHEMA)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {tuple(r) for r in repair.report(ids.limit(0), ids).collect()} == {(1, *none), (2, *none)}
    assert repair.report(ids.limit(0), ids.limit(0)).count() == 0


def test_repaired_turns_are_a_table(spark):
    data = {5: [(0, "user", "Hi."), (1, "user", "Hi."), (2, "user", "long " * 100000)], 6: [(0, "system", "S."), (1, "user", "U.")]}
    frame = spark.createDataFrame([(c, t, r, x, "k", 1) for c, ts in data.items() for t, r, x in ts], SCHEMA)
    rows = repair.prepared(frame)
    got = sorted(map(tuple, repair.repaired(rows, repair.audits(rows)[1]).collect()))
    assert got == [("5", 0, "user", "Hi."), ("5", 1, "assistant", "long " * 100000), ("6", 0, "system", "S."),
                   ("6", 1, "user", "U."), ("6", 2, "assistant", "")]
