"""Repair of conversation structure by the cheapest audit.

An audit names an edit for each row (Keep, Rerole, Delete) and the Inserts between them; the
cheapest one whose roles read ``(s?(ua)+)?`` wins, ties going to the ASCII-least audit.  The
dynamic programme walks the states of that pattern and keeps audits as linked nodes that
share their prefixes: binary-lifting ancestors and rolling hashes find where two audits of
one cost part, and the nodes between are compared, so that equal hashes are never trusted.

A conversation may hold any share of all rows: it is cut into blocks of ``BLOCK`` turns, each
solved in its own task from every state it may start in to every state it may end in, and
written with the order of its audits.  All audits of a block end with an edit of the same
row, so none begins another one, and comparing two concatenations means comparing blocks
from the left by that order.  So ``FAN`` blocks are joined into one by the same programme,
level by level, until one is left; choices then travel back down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import prepare, stored
from portrisk.llm.running import running

#: Turns solved in one piece, and pieces joined into one a level.
BLOCK = 1024
FAN = 256
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; where u or a leads.
STEP = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Inserts that end a conversation by its last state.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
STARTS = 4
#: Rolling hashes of audits.
PRIME, FACTOR = (1 << 61) - 1, 911_382_323
#: ASCII white space; anything else is content.
SPACE = " \t\n\x0b\x0c\r"

#: Of a row or block: by start state, (end state, cost, symbols appended to the audit).
Table = dict[int, list[tuple[int, int, tuple[int, ...]]]]


class Audits:
    """Strings of symbols as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.symbol, self.state, self.depth, self.hash = [0], [0], [0], [0]
        self.up: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4, ... nodes above

    def append(self, node: int, symbol: int, state: int) -> int:
        """The node of ``node``'s string and one more symbol; ``state`` is kept with it."""
        ups = [node]
        while len(self.up[ups[-1]]) >= len(ups):
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.symbol.append(symbol)
        self.state.append(state)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * FACTOR + symbol + 1) % PRIME)
        self.up.append(tuple(ups))
        return len(self.symbol) - 1

    def _above(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _difference(self, x: int, y: int) -> tuple[int, int] | None:
        """The first nodes in which two strings of one length differ; None if they are equal."""
        first = None
        while x != y:
            if self.symbol[x] != self.symbol[y]:
                first = x, y
            x, y = self.up[x][0], self.up[y][0]
        return first

    def less(self, a: int, b: int) -> bool:
        """Is the string of ``a`` before that of ``b``?  A string is before its extensions."""
        short = min(self.depth[a], self.depth[b])
        x, y = self._above(a, short), self._above(b, short)
        if self.hash[x] != self.hash[y]:  # search the longest common prefix
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            at = self._difference(self.up[x][0], self.up[y][0]) or (x, y)  # equal hashes verified
        else:
            at = self._difference(x, y)
        if at is None:
            return self.depth[a] < self.depth[b]
        return self.symbol[at[0]] < self.symbol[at[1]]

    def read(self, node: int) -> tuple[list[int], list[int]]:
        """Symbols of a node's string and the states kept with them."""
        symbols, states = [], []
        while node:
            symbols.append(self.symbol[node])
            states.append(self.state[node])
            node = self.up[node][0]
        return symbols[::-1], states[::-1]


def row_table(initial: str, faulty: bool, cut: bool) -> Table:
    """Edits of one row: of its role's initial, blank or repeated (``faulty``), truncated (``cut``).

    Inserts come before the edit.  None comes before a Delete: deleting first costs the same
    and reads less.  More than two never help, as the states repeat.
    """
    table: Table = {}
    for start in STEP:
        best = {start: (DELETE, "D")}

        def offer(state: int, cost: int, audit: str) -> None:
            best[state] = min(best.get(state, (cost, audit)), (cost, audit))
        state = start
        for n in range(0 if faulty else 3):
            to, paid, before = STEP[state], n * INSERT + cut * CUT, "I" * n
            if initial == "s" and state == 0:
                offer(1, paid, before + "K")
            if initial == ROLE[to][0]:
                offer(to, paid, before + "K")
            offer(to, paid + REROLE, before + "R")
            state = to
        table[start] = [(q, cost, tuple(audit.encode())) for q, (cost, audit) in best.items()]
    return table


def solve(items: list[Table], starts: range) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(start, end, cost, symbols, states) of the best string through all items, for each start
    and end state that items connect; ``states`` are the end states item by item for items
    that append one symbol each."""
    out = []
    for start in starts:
        audits = Audits()
        at = {start: (0, 0)}
        for table in items:
            nxt: dict[int, tuple[int, int]] = {}
            for p, (paid, node) in at.items():
                for q, cost, symbols in table.get(p, ()):
                    had = nxt.get(q)
                    if had is not None and had[0] < paid + cost:
                        continue
                    new = node
                    for s in symbols:
                        new = audits.append(new, s, q)
                    if had is None or paid + cost < had[0] or audits.less(new, had[1]):
                        nxt[q] = paid + cost, new
            at = nxt
        out += [(start, q, cost, *audits.read(node)) for q, (cost, node) in at.items()]
    return out


_ENTRIES = "array<struct<p:int,q:int,cost:bigint,place:int,how:string>>"
_ENTRY = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()),
                             ("how", pa.string())]))


def _entries(found: list[tuple[int, int, int, list[int], list[int]]], how: Callable[[list[int], list[int]], str]) -> list[dict]:
    """Solutions with the place of their string in the order of all; equal strings share one."""
    order = {s: k for k, s in enumerate(sorted({tuple(f[3]) for f in found}))}
    return [{"p": p, "q": q, "cost": cost, "place": order[tuple(symbols)], "how": how(symbols, states)}
            for p, q, cost, symbols, states in found]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns, as (key, the rows' other columns)."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield key, rows


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``turns`` (the four columns) as faulty input for the repair, by CRC-32 of ``id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats
    the row, 4 makes its role user.  Nulls count as one space; a null turn stays null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(id_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(id_col), F.col(turn_col), text(role_col).alias("role_"), text(text_col).alias("text_"),
                        kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        id_col, turn_col, F.when(F.col("kind") == 4, "user").otherwise(F.col("role_")).alias(role_col),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text_", ".!?", ""))
        .otherwise(F.col("text_")).alias(text_col),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def conv_key(id_: Column) -> Column:
    """A conversation's id as text that is never null: one space for null."""
    return F.coalesce(id_.cast("string"), F.lit(" "))


def prepared(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """The written rows that ``audits`` and ``repaired`` read: (conv, turn, role, text, mark, row)."""
    prepare(turns.sparkSession)
    rows = turns.select(conv_key(F.col(id_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    return stored(rows.select("*", F.unhex(F.sha2("text", 256)).alias("mark"),
                              F.monotonically_increasing_id().alias("row")), "turns")


_ORDER = ["conv", "turn", "role", "mark", "row"]


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, nth, initial, fault) of all rows; ``nth`` counts a conversation's rows from 0,
    ``fault`` is the first of blank, duplicate, truncated that applies, else null.

    The first row of equal ones is found by an aggregate and joined by its own place, so that
    no key holds more than one row of a join."""
    last = F.expr(f"substring(trim(TRAILING '{SPACE}' FROM text), -1, 1)")
    keys = rows.select("conv", "turn", "role", "mark", "row", F.substring("role", 1, 1).alias("initial"),
                       (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    placed = running(keys, [F.col(c) for c in _ORDER], {"place": F.lit(1).cast("long")}, "places")
    placed = stored(placed, "placed")
    seen = placed.groupBy("conv", "role", "mark").agg(F.min("place").alias("at"))
    first = placed.groupBy(F.col("conv").alias("of")).agg(F.min("place").alias("first_place"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("at").isNull(), "duplicate")
             .when(F.col("cut"), "truncated"))
    return (placed.drop("role", "mark", "row").join(seen.select("at"), F.col("place") == F.col("at"), "left")
            .join(first, F.col("conv") == F.col("of"))
            .select("conv", "turn", (F.col("place") - F.col("first_place")).alias("nth"), "initial", fault.alias("fault")))


def _solved(faults: DataFrame) -> DataFrame:
    """(conv, block, entries, illegal, first, last) of all blocks of ``BLOCK`` rows."""
    types: dict[tuple, Table] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _groups(batches, 2):
            items = []
            for _, initial, fault in rows:
                kind = initial, fault in ("blank", "duplicate"), fault == "truncated"
                if kind not in types:
                    types[kind] = row_table(*kind)
                items.append(types[kind])
            found = solve(items, range(STARTS if block else 1))
            pairs = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
            yield pa.record_batch([
                pa.array([conv]), pa.array([block], pa.int64()),
                pa.array([_entries(found, lambda symbols, _: bytes(symbols).decode())], _ENTRY),
                pa.array([pairs], pa.int64()), pa.array([rows[0][1]]), pa.array([rows[-1][1]])],
                names=["conv", "block", "entries", "illegal", "first", "last"])
    block = F.floor(F.col("nth") / BLOCK).alias("block")
    return stored(faults.select("conv", block, "nth", "initial", "fault").repartition("conv", "block")
                  .sortWithinPartitions("conv", "block", "nth")
                  .mapInArrow(run, f"conv string, block long, entries {_ENTRIES}, illegal long, first string, last string"),
                  "blocks")


def _joined(blocks: DataFrame) -> DataFrame:
    """(conv, block, entries): ``FAN`` neighbouring blocks as one; ``how`` tells their end states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, group), rows in _groups(batches, 2):
            items = []
            for _, entries in rows:
                table: Table = {}
                for e in entries:
                    table.setdefault(e["p"], []).append((e["q"], e["cost"], (e["place"],)))
                items.append(table)
            found = solve(items, range(STARTS if group else 1))
            yield pa.record_batch([pa.array([conv]), pa.array([group], pa.int64()),
                                   pa.array([_entries(found, lambda _, states: "".join(map(str, states)))], _ENTRY)],
                                  names=["conv", "block", "entries"])
    group = F.floor(F.col("block") / FAN).alias("grp")
    return stored(blocks.select("conv", group, "block", "entries").repartition("conv", "grp")
                  .sortWithinPartitions("conv", "grp", "block")
                  .mapInArrow(run, f"conv string, block long, entries {_ENTRIES}"), "joined")


def _how(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """``chosen`` (conv, block, p, q) with the matching entry's ``how``."""
    of = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), "entries")
    entry = F.expr("filter(entries, e -> e.p = p AND e.q = q)[0].how")
    return (chosen.join(of, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b")))
            .select("conv", "block", "p", "q", entry.alias("how")))


def audits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables from ``prepared`` rows.

    One row per conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost), and its
    audit in pieces: (conv, block, piece), the last piece with the final Inserts.

    Rows come in order of turn (null first), role, SHA-256 of the text.  Gaps are numbers
    missing between the least and greatest turn; faults count once a row; null role and text
    are one space; equal rows at one turn are duplicates; an empty table gives empty tables.
    """
    faults = stored(_faults(rows), "faults")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    per = faults.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    turns = faults.filter("turn is not null").select("conv", "turn").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    levels = [_solved(faults)]
    after = levels[0].select(F.col("conv").alias("c"), (F.col("block") - 1).alias("b"), F.col("first").alias("follows"))
    apart = ~F.concat("last", "follows").isin("su", "ua", "au")
    illegal = (levels[0].join(after, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b")), "left")
               .groupBy("conv").agg((F.sum("illegal") + F.count(F.when(apart, 1))).alias("illegal")))
    while not levels[-1].filter("block > 0").isEmpty():
        levels.append(_joined(levels[-1]))
    tail = F.create_map(*[F.lit(x) for q, inserts in TAIL.items() for x in (q, inserts)])
    ends = (levels[-1].select("conv", F.explode("entries").alias("e")).select("conv", "e.p", "e.q", "e.cost", "e.place")
            .withColumn("tail", tail[F.col("q")]).withColumn("cost", F.col("cost") + INSERT * F.length("tail")))
    best = stored(ends.groupBy("conv").agg(F.min(F.struct("cost", "place", "p", "q", "tail")).alias("m"))
                  .select("conv", "m.cost", "m.p", "m.q", "m.tail"), "best")
    chosen = best.select("conv", F.lit(0).cast("long").alias("block"), "p", "q")
    for level in levels[:0:-1]:
        nth = F.explode(F.sequence(F.lit(0), F.length("how") - 1)).alias("nth")
        chosen = (_how(chosen, level).select("conv", "block", "p", "how", nth)
                  .select("conv", (F.col("block") * FAN + F.col("nth")).alias("block"),
                          F.when(F.col("nth") == 0, F.col("p")).otherwise(F.expr("substring(how, nth, 1)").cast("int")).alias("p"),
                          F.expr("substring(how, nth + 1, 1)").cast("int").alias("q")))
        chosen = stored(chosen, "chosen")
    most = levels[0].groupBy(F.col("conv").alias("c")).agg(F.max("block").alias("last_block"))
    ending = best.select(F.col("conv").alias("c"), "tail").join(most, "c")
    pieces = (_how(chosen, levels[0]).join(ending, F.col("conv") == F.col("c"))
              .select("conv", "block", F.concat("how", F.when(F.col("block") == F.col("last_block"), F.col("tail"))
                                                .otherwise(F.lit(""))).alias("piece")))
    table = (per.join(gaps, "conv", "left").join(illegal, "conv").join(best.select("conv", "cost"), "conv")
             .select("conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated",
                     "illegal", "cost"))
    return table, pieces


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(conv, role, text, None) of each repaired turn, then (conv, None, None, audit) of each
    conversation, from its audit's pieces followed by its rows in order."""
    conv, audit, at, state = None, [], 0, 0
    whole = ""

    def rest() -> Iterator[tuple[str, str | None, str | None, str | None]]:
        nonlocal state
        for _ in whole[at:]:  # final inserts
            state = STEP[state]
            yield conv, ROLE[state], "", None
        yield conv, None, None, whole
    for b in batches:
        for c, kind, role, text in zip(*(col.to_pylist() for col in b.columns)):
            if c != conv:
                if conv is not None:
                    yield from rest()
                conv, audit, at, state, whole = c, [], 0, 0, ""
            if kind == 0:
                audit.append(text)
                continue
            if not whole:
                whole, audit = "".join(audit), []
            while whole[at] == "I":
                state, at = STEP[state], at + 1
                yield conv, ROLE[state], "", None
            edit, at = whole[at], at + 1
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[:1] == "s" else STEP[state]
            yield conv, role if edit == "K" else ROLE[state], text, None
    if conv is not None:
        yield from rest()


def _in_order(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv, kind, role, text): each conversation's audit pieces, then its rows, in one task.

    Every text travels once; a task streams them and holds one audit (a letter a row)."""
    null = lambda t: F.lit(None).cast(t)
    both = (pieces.select("conv", F.lit(0).alias("kind"), "block", null("long").alias("turn"), null("string").alias("role"),
                          null("binary").alias("mark"), null("long").alias("row"), F.col("piece").alias("text"))
            .union(rows.select("conv", F.lit(1), F.lit(0).cast("long"), "turn", "role", "mark", "row", "text")))
    return (both.repartition("conv").sortWithinPartitions("conv", "kind", "block", *_ORDER[1:])
            .select("conv", "kind", "role", "text"))


def repaired(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv, nth, role, text) of all turns after the edits of ``audits``, ``nth`` from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, out = 0, []
        for conv, role, text, audit in _edited(batches):
            if audit is None:
                out.append((conv, nth, role, text))
            nth = nth + 1 if audit is None else 0
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
    names = ["conv", "nth", "role", "text"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string()])))
    return _in_order(rows, pieces).mapInArrow(run, "conv string, nth long, role string, text string")


def digests(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the whole audit and the hash of the repaired turns'
    ``role:text``, joined by line breaks and hashed while they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, first = hashlib.sha256(), True
        for conv, role, text, audit in _edited(batches):
            if audit is None:
                hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
                continue
            yield pa.record_batch([pa.array([conv]), pa.array([audit]), pa.array([hashed.hexdigest()])],
                                  names=["conv", "audit", "repaired_sha256"])
            hashed, first = hashlib.sha256(), True
    return _in_order(rows, pieces).mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def report(turns: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per distinct id of ``ids``: (id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256) of its rows in ``turns``; zeros and empty texts if it has none.

    Rows without an id form one conversation with a null id; other columns are ignored; an
    empty table of ids gives an empty table.
    """
    rows = prepared(turns, id_col, turn_col, role_col, text_col)
    table, pieces = audits(rows)
    found = stored(table.join(digests(rows, stored(pieces, "audits")), "conv").withColumnRenamed("conv", "c"), "report")
    all_ = ids.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return all_.join(found, conv_key(F.col("id")) == F.col("c"), "left").select(
        "id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(0, 9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1
                         THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc FROM range(256) t(i)),
c AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key
      FROM conversations),
d AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(key, lambda x: ascii(x)::BIGINT)),
             lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM c, crc),
e AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, range(2) r(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM e),
f AS (SELECT c, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prior,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN i > min(i) OVER (PARTITION BY c, role, text) THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM k),
m AS (FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2),
                   (3, 0, 3), (3, 1, 2), (3, 2, 3)) t(p, inserts, s)),
o AS (FROM (VALUES ('D', 0, 0, '', 3), ('D', 1, 1, '', 3), ('D', 2, 2, '', 3), ('D', 3, 3, '', 3),
                   ('K', 0, 1, 's', 0), ('K', 0, 2, 'u', 0), ('K', 1, 2, 'u', 0), ('K', 3, 2, 'u', 0), ('K', 2, 3, 'a', 0),
                   ('R', 0, 2, '', 2), ('R', 1, 2, '', 2), ('R', 3, 2, '', 2), ('R', 2, 3, '', 2)) t(edit, s, q, needs, cost)),
w AS (SELECT i, m.p, o.q, 2 * inserts + cost + (CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END) AS cost,
             repeat('I', inserts) || edit AS edits, c
      FROM f JOIN m ON true JOIN o ON o.s = m.s
      WHERE (needs = '' OR needs = initial) AND (edit = 'D' OR fault IS NULL OR fault = 'truncated')),
g AS (SELECT c, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': ''} AS v FROM (SELECT DISTINCT c FROM e)
      UNION ALL
      SELECT g.c, w.i, w.q, min({'cost': (v.cost + w.cost)::BIGINT, 'audit': v.audit || w.edits})
      FROM g JOIN w ON w.c = g.c AND w.i = g.i + 1 AND w.p = g.s GROUP BY g.c, w.i, w.q),
h AS (SELECT c, min({'cost': v.cost + 2 * t, 'audit': v.audit || repeat('I', t::INTEGER)}) AS v
      FROM g JOIN (SELECT c, max(i) AS n FROM f GROUP BY c) USING (c) JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) t(s, t)
           USING (s) WHERE i = n GROUP BY c),
a AS (SELECT c, v.audit AS audit, unnest(range(1, len(v.audit) + 1)) AS nth FROM h),
b AS (SELECT c, nth, audit[nth] AS edit, len(replace(audit[1:nth], 'I', '')) AS i,
             len(replace(audit[1:nth], 'D', '')) + len(replace(audit, 'D', '')) % 2 AS place FROM a),
r AS (SELECT b.c, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                             CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS repaired
      FROM b LEFT JOIN f ON f.c = b.c AND f.i = b.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY b.c),
x AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations)
LEFT JOIN x USING (c) LEFT JOIN h USING (c) LEFT JOIN r USING (c)
"""
