"""Secret scans that unwrap encoded layers.

Every text is the first layer of a worklist.  A layer is scanned for secrets; then each way
it is encoded in yields another layer: percent escapes, Unicode escapes, base64 runs and
compressed data inside them, until no layer yields one that is new (the same text over the
same place is a cycle and is not taken up again).  Each code point of a layer knows the span
of the document it comes from, so that what is found in any layer is told as a span of the
document.  Patterns never cross a line, so escapes are undone line by line, and data that
unpacks to any size streams by in pieces.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import prepare

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 8

#: A percent escape; escapes of the percent sign itself are undone with it, however deep.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_PERCENT_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
#: A run of backslashes is read once, from its start.
UNICODE = re.compile(r"(?<!\\)\\++(?:u\{([0-9A-Fa-f]{1,6})\}|u([Dd][89ABab][0-9A-Fa-f]{2})\\++u([Dd][C-Fc-f][0-9A-Fa-f]{2})"
                     r"|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&\#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
#: Base64 in either alphabet.  The shortest secret fills 16 bytes or, as an assignment, 14.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{18,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{18,}+(?:\r?\n[A-Za-z0-9+/_-]++)+")
_ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")  # all that a secret or another escape is made of
_LINE = re.compile(r"[^\r\n]+")
#: Bytes of unpacked data held at once, and how much of a piece without lines the next one sees again.
PIECE, OVERLAP = 1 << 22, 1 << 14
_READ = 1 << 16
#: Compressed data in compressed data is read on as it streams where it exceeds a piece, this deep.
NEST = 64


@dataclass
class Layer:
    """A text and, for each of its code points, the span of the document it comes from:
    from ``starts[i]`` to ``ends[i]``; all of ``[starts, ends)`` where these are two numbers."""

    text: str
    starts: np.ndarray | int
    ends: np.ndarray | int

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[a]), int(self.ends[b - 1])


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the secrets in one layer, leftmost and not overlapping by kind."""
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end() - m.start(1) >= LEAST_VALUE:
                yield m.start(), m.end(), 0
    # a shorter run of these letters holds no longer one, so the least length may stand in the pattern
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind


def _replaced(layer: Layer, a: int, b: int, pattern: re.Pattern, decode: Callable[[re.Match], list[tuple[str, int, int]]]
              ) -> Layer | None:
    """The line ``[a, b)`` of a layer with all matches of ``pattern`` replaced by the pieces
    ``decode`` gives for them (text, from, to in the line); None if nothing changes."""
    line = layer.text[a:b]
    out, first, last, at, changed = [], [], [], 0, False

    def keep(to: int) -> None:
        out.append(line[at:to])
        first.extend(range(at, to))
        last.extend(range(at, to))
    for m in pattern.finditer(line):
        pieces = decode(m)
        if not pieces:
            continue
        keep(m.start())
        at, changed = m.end(), True
        for text, lo, hi in pieces:
            out.append(text)
            first.extend([lo] * len(text))
            last.extend([hi - 1] * len(text))
    if not changed:
        return None
    keep(len(line))
    text = "".join(out)
    if isinstance(layer.starts, int):
        return Layer(text, layer.starts, layer.ends)
    return Layer(text, layer.starts[a:b][np.array(first, np.int64)], layer.ends[a:b][np.array(last, np.int64)])


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    """The characters of a run of percent escapes; bytes that are no UTF-8 stay escaped."""
    at, data = [], bytearray()
    for one in _PERCENT_ONE.finditer(m.group()):
        at.append((m.start() + one.start(), m.start() + one.end()))
        data.append(int(one.group(1), 16))
    out, k = [], 0
    while k < len(data):
        lead = data[k]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            text = bytes(data[k:k + n]).decode() if n else ""
        except UnicodeDecodeError:
            text = ""
        if not text:
            n, text = 1, f"%{lead:02X}"
        out.append((text, at[k][0], at[min(k + n, len(at)) - 1][1]))
        k += n
    # what decodes to itself is no new layer
    return out if "".join(t for t, _, _ in out) != m.group() else []


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    braced, high, low, four, eight, two, html16, html10 = m.groups()
    if high:
        code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00
    else:
        code = int(html10) if html10 else int(braced or four or eight or two or html16, 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return []
    return [(chr(code), m.start(), m.end())]


class _Stream:
    """Chunks of bytes as a file to read."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.rest = chunks, b""

    def read(self, size: int) -> bytes:
        while not self.rest:
            chunk = next(self.chunks, None)
            if chunk is None:
                return b""
            self.rest = chunk
        out, self.rest = self.rest[:size], self.rest[size:]
        return out


def _zstd(chunks: Iterator[bytes]) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(_Stream(chunks), read_across_frames=True) as r:
        while got := r.read(_READ):
            yield got


def _stepwise(make: Callable[[], object]) -> Callable[[Iterator[bytes]], Iterator[bytes]]:
    def run(chunks: Iterator[bytes]) -> Iterator[bytes]:
        d, stream, data = make(), _Stream(chunks), b""
        while True:
            data = data or (stream.read(_READ) if getattr(d, "needs_input", True) else b"")
            if not data and getattr(d, "needs_input", True):
                return
            got = d.decompress(data, _READ)
            data = getattr(d, "unconsumed_tail", b"")
            if d.eof:
                data = d.unused_data or stream.read(_READ)
                d = make()
            if got:
                yield got
    return run


#: First bytes of compressed data and how it is unpacked, a little at a time.
UNPACK: list[tuple[re.Pattern, Callable[[Iterator[bytes]], Iterator[bytes]]]] = [
    (re.compile(rb"\x1f\x8b\x08"), _stepwise(lambda: zlib.decompressobj(31))),
    (re.compile(rb"\x78[\x01\x5e\x9c\xda]"), _stepwise(lambda: zlib.decompressobj(15))),
    (re.compile(rb"BZh[1-9]1AY&SY"), _stepwise(bz2.BZ2Decompressor)),
    (re.compile(rb"\xfd7zXZ\x00"), _stepwise(lambda: lzma.LZMADecompressor(memlimit=1 << 28))),
    (re.compile(rb"\x28\xb5\x2f\xfd"), _zstd),
]
_FAILS = (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError)


def _safe(stream: Iterator[bytes]) -> Iterator[bytes]:
    """What is unpacked before an error counts."""
    try:
        yield from stream
    except _FAILS:
        return


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of ``data`` as they are unpacked, compressed data inside them too; nothing
    if ``data`` isn't compressed.  Data that unpacks to data met before is a cycle."""
    chunks, head, seen, nested = iter([data]), data, set(), 0
    while unpack := next((f for start, f in UNPACK if start.match(head)), None):
        stream = _safe(unpack(chunks))
        held = bytearray()
        for got in stream:
            held += got
            if len(held) > PIECE or not any(start.match(held) for start, _ in UNPACK) and len(held) > 16:
                break
        else:
            stream = iter(())
        head = bytes(held)
        mark = hashlib.blake2b(head, digest_size=16).digest()
        nested += len(held) > PIECE
        if mark in seen or nested > NEST:
            return
        seen.add(mark)
        chunks = chain([head], stream)
    if seen:
        yield from chunks


def _packed_layers(data: bytes, lo: int, hi: int) -> Iterator[Layer]:
    """Unpacked text over the span [lo, hi), in pieces that end between lines where they can."""
    tail = b""
    for got in _unpacked(data):
        tail += got
        if len(tail) >= PIECE:
            cut = tail.rfind(b"\n") + 1
            text, tail = (tail[:cut], tail[cut:]) if cut else (tail, tail[-OVERLAP:])
            yield Layer(text.decode("latin-1"), lo, hi)
    if tail:
        yield Layer(tail.decode("latin-1"), lo, hi)


_URL_SAFE = str.maketrans("-_", "+/")


def _base64_layers(layer: Layer, places: np.ndarray) -> Iterator[Layer]:
    """Layers of the base64 letters at ``places`` of a layer: text and compressed data for each
    of the four ways to cut them into fours."""
    a, b = int(places[0]), int(places[-1]) + 1
    run = layer.text[a:b].replace("\r", "").replace("\n", "").translate(_URL_SAFE)
    for shift in range(4):
        letters = run[shift:]
        data = base64.b64decode(letters[:-1] if len(letters) % 4 == 1 else letters + "=" * (-len(letters) % 4))
        for m in _ASCII.finditer(data):
            text = m.group().decode()
            if isinstance(layer.starts, int):
                yield Layer(text, layer.starts, layer.ends)
            else:
                bits = np.arange(m.start(), m.end()) * 8
                first, last = places[shift + bits // 6], places[shift + (bits + 7) // 6]  # letters that hold the byte
                yield Layer(text, layer.starts[first], layer.ends[last])
        if any(head.match(data) for head, _ in UNPACK):
            yield from _packed_layers(data, *layer.span(int(places[shift]), b))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly below one: each line with escapes undone, each base64 run decoded."""
    text = layer.text
    for sign, pattern, decode in (("%", PERCENT, _percent), ("\\&", UNICODE, _unicode)):
        if any(c in text for c in sign):
            last = -1
            for m in pattern.finditer(text):
                if m.start() < last:
                    continue
                a = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
                line = _LINE.match(text, a)
                last = line.end()
                below = _replaced(layer, a, last, pattern, decode)
                if below is not None:
                    yield below
    for m in BASE64.finditer(text):
        yield from _base64_layers(layer, np.arange(m.start(), m.end()))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield from _base64_layers(layer, np.array([k for k in range(*m.span()) if text[k] not in "\r\n"]))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all): spans (start, end, kind) of the secrets of a text, in order of start, then
    kind; ``base`` are those in the text as it stands, ``all`` also those in its layers."""
    text = text or ""
    base = sorted(matches(text), key=lambda s: (s[0], s[2]))
    found, seen = set(base), set()
    first = Layer(text, 0, 0)
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return base, base
    first.starts = np.arange(len(text), dtype=np.int64)
    first.ends = first.starts + 1
    work = [unwrapped(first)]  # one open iterator a depth: layers are made when they are taken up
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16,
                               key=b"%d:%d" % layer.span(0, len(layer.text))).digest()
        if mark in seen:
            continue
        seen.add(mark)
        for a, b, kind in matches(layer.text):
            found.add((*layer.span(a, b), kind))
        work.append(unwrapped(layer))
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    """Spans as ``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, base, found), each an array of (kind, start, end).

    Offsets are code points, ends exclusive; ``base`` are the secrets in the text as it
    stands, ``found`` these and the ones in encoded layers.  Null texts count as empty; ids
    pass through, null or repeated; texts of any length are read whole; an empty table gives
    an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def told(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([told(g[0]) for g in got], span),
                                   pa.array([told(g[1]) for g in got], span)], names=["id", "base", "found"])
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id long, base {spans}, found {spans}")
