"""Byte-level BPE ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: Code points on which both libraries split words alike (Latin blocks, general punctuation).
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
#: A run of this many characters without a space or line break goes to tokenizers, whose
#: merging doesn't slow down with a word's length.
_RUN = 1000


class ByteBpe:
    """Encoder for a byte-level BPE vocabulary file of the tokenizers library.

    Special strings inside a text become their ids and no token is added, as with
    ``Tokenizer.encode(text, add_special_tokens=False)``.  ``ranks`` names the same vocabulary
    in tiktoken's format: texts of Latin letters are then encoded by tiktoken, which gives the
    same ids several times faster; all others are encoded by tokenizers itself.
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer
        self._slow = Tokenizer.from_file(path)
        self._slow.no_truncation()
        self._slow.no_padding()
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(path, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                           special_tokens=special)

    def _plain(self, text: str) -> bool:
        if not text.isascii() and _OTHER.search(text):
            return False
        blocks = (text[i:i + _RUN] for i in range(0, len(text) - _RUN + 1, _RUN))
        return all((" " in b or "\n" in b) and not b.isspace() for b in blocks)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as 32-bit unsigned integers."""
        if self._fast is not None and self._plain(text):
            return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without loss for ids of one encoded text."""
        if self._fast is not None:
            return self._fast.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")
        return self._slow.decode(ids.tolist(), skip_special_tokens=False)

    @property
    def size(self) -> int:
        """Number of ids; the next ones are free for reserved tokens."""
        return self._slow.get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=4)
def byte_bpe(path: str, ranks: str | None = None) -> ByteBpe:
    """The encoder for these files, loaded once a process."""
    return ByteBpe(path, ranks)
