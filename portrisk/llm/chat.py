"""Chat formatting at token level.

Every text is encoded on its own and reserved ids, which no text can yield, are spliced
around it, so no token spans a border.  Control strings inside texts are escaped first, so
that the formatted text can be parsed as well as the ids.  Positions in a conversation and
the spans under the loss mask are prefix sums of segment lengths, taken over the whole table
in ranges: one conversation may hold any share of all turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.bpe import ByteBpe, byte_bpe
from portrisk.llm.common import prepare, stored
from portrisk.llm.running import running

#: Reserved tokens in order of their ids, which follow the vocabulary's, and their strings.
RESERVED = ("### System: ", "### User: ", "### Assistant: ", "### ", ": ", "</turn>\n")
OPENERS = {"system": 0, "user": 1, "assistant": 2}
OTHER, MIDDLE, CLOSE = 3, 4, 5
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|#(?=#)|<(?=/turn>|\|endoftext\|>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` with a backslash after each backslash and inside each control string."""
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role without an opener of its own, told apart from the openers' names and ": "."""
    named = "\\" + role if role in {RESERVED[k][4:-2] for k in OPENERS.values()} else escape(role)
    return named.replace(RESERVED[MIDDLE], ":\\ ")


def format_turn(bpe: ByteBpe, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn, and the lengths of its segments: opener, text, closer."""
    base, body = bpe.size, bpe.encode(escape(text))
    if role in OPENERS:
        head = np.array([base + OPENERS[role]], "<u4")
    else:
        head = np.concatenate([[base + OTHER], bpe.encode(escape_role(role)), [base + MIDDLE]]).astype("<u4")
    return np.concatenate([head, body, [base + CLOSE]]).astype("<u4"), np.array([len(head), len(body), 1])


def _width(bpe: ByteBpe) -> str:
    return "<u2" if bpe.size + len(RESERVED) <= 1 << 16 else "<u4"


def packed_ids(bpe: ByteBpe, ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned integers of 16 bits, of 32 for larger vocabularies."""
    return ids.astype(_width(bpe)).tobytes()


def unpacked_ids(bpe: ByteBpe, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _width(bpe)).astype("<u4")


def loss_mask(lengths: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Per token: is it in a segment to learn?  By prefix sums of the segments' lengths."""
    ends = np.cumsum(lengths)
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(step, (ends - lengths)[learn], 1)
    np.add.at(step, ends[learn], -1)
    return np.cumsum(step)[:-1] > 0


def render(bpe: ByteBpe, ids: np.ndarray) -> str:
    """The formatted text of ids: reserved ids as their strings, the rest decoded."""
    out, at = [], 0
    for k in [*np.nonzero(ids >= bpe.size)[0].tolist(), len(ids)]:
        out.append(bpe.decode(ids[at:k]))
        if k < len(ids):
            out.append(RESERVED[int(ids[k]) - bpe.size])
        at = k + 1
    return "".join(out)


def parse_turn(bpe: ByteBpe, ids: np.ndarray) -> tuple[str, str]:
    """(role, text) read back from the ids of one turn."""
    kind = int(ids[0]) - bpe.size
    if kind == OTHER:
        middle = int(np.nonzero(ids == bpe.size + MIDDLE)[0][0])
        role = unescape(bpe.decode(ids[1:middle]))
    else:
        middle, role = 0, next(r for r, k in OPENERS.items() if k == kind)
    return role, unescape(bpe.decode(ids[middle + 1:-1]))


def parse_text(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn read back from the formatted text of a conversation."""
    turns = []
    for part in formatted.split(RESERVED[CLOSE])[:-1]:
        role, text = part.removeprefix(RESERVED[OTHER]).split(RESERVED[MIDDLE], 1)
        known = {RESERVED[k][4:-2]: r for r, k in OPENERS.items()}
        turns.append((known.get(role, unescape(role)), unescape(text)))
    return turns


def formatted(turns: DataFrame, bpe_path: str, ranks_path: str | None = None, id_col: str = "conv_id",
              turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of ``turns``: (conv, turn, nth, ids binary, start, loss_start, loss_end).

    ``ids`` are packed as ``packed_ids`` does; ``unpacked_ids`` gives them back.
    ``nth`` counts a conversation's turns from 0 in order of turn (null last), role, hash of the text;
    ``start`` is the place of the turn's ids in the conversation, [loss_start, loss_end) the
    part of the conversation to learn from (empty but for assistants).  Null role and text
    count as empty, rows without conversation id form one conversation, repeated rows are
    turns like any other; other columns are ignored; an empty table gives an empty table.
    """
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(bpe_path, ranks_path)
        for b in batches:
            got = [format_turn(bpe, r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            size = [g[1] for g in got]
            yield pa.record_batch([*b.columns[:3], b.column(4), pa.array([packed_ids(bpe, g[0]) for g in got], pa.binary()),
                                   pa.array([int(s.sum()) for s in size], pa.int64()),
                                   pa.array([int(s[0]) for s in size], pa.int64())],
                                  names=["conv", "turn", "role", "mark", "ids", "n", "head"])
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stored(rows.withColumn("mark", F.xxhash64("text")).mapInArrow(
        run, "conv long, turn long, role string, mark long, ids binary, n long, head long")
        .withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("mark"), F.col("row")]
    placed = running(rows.drop("ids"), order, {"place": F.lit(1), "at": F.col("n")}, "places")  # without the ids
    first = placed.groupBy("conv").agg(F.min("place").alias("first_place"), F.min("at").alias("first_at"))
    start = F.col("at") - F.col("first_at")
    learn = F.col("role") == LOSS_ROLE
    spans = (placed.join(first.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
             .select("row", "conv", "turn", (F.col("place") - F.col("first_place")).alias("nth"), start.alias("start"),
                     F.when(learn, start + F.col("head")).otherwise(start).alias("loss_start"),
                     F.when(learn, start + F.col("n") - 1).otherwise(start).alias("loss_end")))
    return (rows.select("row", "ids").join(spans.hint("shuffle_hash"), "row")
            .select("conv", "turn", "nth", "ids", "start", "loss_start", "loss_end"))


def read_back(rows: DataFrame, bpe_path: str, ranks_path: str | None = None) -> DataFrame:
    """(conv, nth, role, text, loss, chars) of every turn, from its ids and mask alone.

    ``loss`` is the unescaped text under the mask, ``chars`` the length of the formatted text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(bpe_path, ranks_path)
        for b in batches:
            role, text, loss, chars = [], [], [], []
            for ids, start, lo, hi in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                ids = unpacked_ids(bpe, ids)
                lengths = np.array([lo - start, hi - lo, len(ids) - (hi - start)])
                learnt = ids[loss_mask(lengths, np.array([False, True, False]))]
                r, t = parse_turn(bpe, ids)
                role.append(r)
                text.append(t)
                loss.append(unescape(bpe.decode(learnt)))
                chars.append(len(render(bpe, ids)))
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (role, text, loss)),
                                   pa.array(chars, pa.int64())], names=["conv", "nth", "role", "text", "loss", "chars"])
    return rows.select("conv", "nth", "ids", "start", "loss_start", "loss_end").mapInArrow(
        run, "conv long, nth long, role string, text string, loss string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: (conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars).

    Turns come to their conversation's task in order and feed running hashes one by one, so
    memory doesn't grow with a conversation.  (SHA-256 can't be split; all else is done before.)
    """
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def close() -> pa.RecordBatch:
            conv, n, turns_, loss_n, loss_, chars = state
            return pa.record_batch([pa.array([conv], pa.int64()), pa.array([n], pa.int64()),
                                    pa.array([turns_.hexdigest()]), pa.array([loss_n], pa.int64()),
                                    pa.array([loss_.hexdigest()]), pa.array([chars], pa.int64())], names=names)
        for b in batches:
            done = []
            for conv, role, text, other, chars in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                loss = text if other is None else other
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += chars
            yield from done
        if state is not None:
            yield close()
    once = turns.select("conv", "nth", "role", "text", F.when(F.col("loss") != F.col("text"), F.col("loss")).alias("other"),
                        "chars")  # a learnt text travels once
    return (once.repartition("conv").sortWithinPartitions("conv", "nth").mapInArrow(
        run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
