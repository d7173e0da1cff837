"""Token counts at every prefix of a text, by dynamic programming over a piece vocabulary.

A byte-pair encoding never merges across two characters that stand side by side in no piece,
so a text falls into segments at such places, each encoded on its own.  Inside a segment,
the last token of every prefix is found from the shorter prefixes: it is the one piece that
ends there and that the encoder leaves unmerged beside the last token of the prefix before
it.  Its count is that prefix's count plus one.  Segments repeat, so their counts are kept;
a text's prefix counts are running sums over its segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import prepare

SPACE = "▁"
#: Words and segments a worker keeps at hand; older ones are forgotten and found again.
KEEP = 300_000


class Recent:
    """A dict of at most two generations of ``KEEP`` entries; old ones that are used move on."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= KEEP:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PrefixCounter:
    """Exact token counts of all prefixes for a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self._sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._vocab = {sp.id_to_piece(i) for i in range(sp.get_piece_size())
                       if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self._inside = {p[i:i + 2] for p in self._vocab for i in range(len(p) - 1)}
        if any(p[1] == SPACE != p[0] for p in self._inside):
            raise ValueError("pieces with a space after another character are not supported")
        if sp.encode("a b", out_type=str)[0][0] != SPACE or sp.encode("a  b ") == sp.encode("a b"):
            raise ValueError("a model that adds a space in front and keeps all others is needed")
        self._longest = max(map(len, self._vocab))
        self._fits: dict[tuple[str, str], bool] = {}
        self._segments, self._words = Recent(), Recent()

    def _pair(self, left: str, right: str) -> bool:
        """Does the encoder leave these two pieces (left may be empty) side by side?"""
        # a line break is never merged, so what follows it is encoded as inside a segment
        tokens = self._sp.encode("\n" + (left + right).replace(SPACE, " "), out_type=str)
        if len(self._fits) >= 4 * KEEP:
            self._fits.clear()
        got = self._fits[left, right] = tokens[2:] == ([left, right] if left else [right])
        return got

    def segment(self, s: str) -> tuple[int, ...]:
        """Counts of the prefixes s[:1], s[:2], ... of a segment (spaces written as SPACE)."""
        got = self._segments.get(s)
        if got is not None:
            return got
        vocab, fits = self._vocab, self._fits
        if len(s) == 1 and s not in vocab:
            counts = [len(s.encode("utf-8", "surrogatepass"))]  # byte fallback
        else:
            counts, last = [0], [""]  # of the prefix of each length
            for end in range(1, len(s) + 1):
                for start in range(max(0, end - self._longest), end):
                    piece = s[start:end]
                    if piece in vocab:
                        ok = fits.get((last[start], piece))
                        if self._pair(last[start], piece) if ok is None else ok:
                            last.append(piece)
                            counts.append(counts[start] + 1)
                            break
                else:
                    raise ValueError(f"no last token for {s[:end]!r}")
            del counts[0]
        got = tuple(counts)
        self._segments.put(s, got)
        return got

    def split(self, s: str) -> list[str]:
        """Segments of a text whose spaces are written as SPACE."""
        cut = [0, *(i for i in range(1, len(s)) if s[i - 1:i + 1] not in self._inside), len(s)]
        return [s[a:b] for a, b in zip(cut, cut[1:])] if s else []

    @staticmethod
    def _marked(text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ..., text."""
        if not text:
            return np.zeros(0, np.int32)
        out, total = [], 0
        for s in self.split(self._marked(text)):
            counts = self.segment(s)
            out += [total + c for c in counts]
            total += counts[-1]
        return np.array(out[1:], np.int32)  # the first is the space put in front

    def total(self, text: str) -> int:
        """Token count of the whole text: the last of ``prefixes``."""
        if not text:
            return 0
        marked = " " + text.replace(SPACE, " ")
        if "  " in marked or marked[-1] == " ":  # runs of spaces merge: split before each run only
            return sum(self.segment(s)[-1] for s in self.split(self._marked(text)))
        words = marked[1:].split(" ")
        known = self._words.young.get
        return sum([self._word(w) if (n := known(w)) is None else n for w in words])

    def _word(self, w: str) -> int:
        """Token count of a word with a space in front."""
        n = self._words.get(w)
        if n is None:
            n = sum([self.segment(s)[-1] for s in self.split(SPACE + w)])
            self._words.put(w, n)
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The counter for this model file, loaded once a process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``, from the prefix counts of its segments.

    Null text counts as empty (0 tokens); ids pass through, null or repeated; no other column
    is read; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                                   pa.array([count.total(t or "") for t in texts], pa.int64())],
                                  names=["id", "n_bytes", "n_tokens"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, n_bytes long, n_tokens long")


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, prefix array<int>): prefix[k] is the token count of the first k + 1 characters.

    The stored table answers ``truncated`` and ``fits`` without encoding anything again.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(
                [count.prefixes(t or "").tolist() for t in b.column(1).to_pylist()], pa.list_(pa.int32()))],
                names=["id", "text", "prefix"])
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).mapInArrow(
        run, "id long, text string, prefix array<int>")


def fits(prefix: Column, budget: int) -> Column:
    """Is the whole text within the budget?"""
    return F.coalesce(F.element_at(F.when(F.size(prefix) > 0, prefix), -1), F.lit(0)) <= budget


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """``table`` (rows of ``prefix_table``) with cut_text: its longest prefix within the budget,
    and cut_tokens: that prefix's token count.  (A longer prefix can have fewer tokens.)
    """
    within = F.transform("prefix", lambda c, i: F.when(c <= budget, i + 1))
    n = F.coalesce(F.array_max(within), F.lit(0))
    return (table.withColumn("cut_chars", n)
            .withColumn("cut_text", F.expr("substring(text, 1, cut_chars)"))
            .withColumn("cut_tokens", F.when(n > 0, F.element_at("prefix", F.greatest(n, F.lit(1)))).otherwise(0))
            .drop("cut_chars"))
