"""Operator 7, secret scans with a recursive decoding worklist.

Every text is a layer of bytes, its UTF-8. A layer is searched for secrets, and these become layers of
their own on the worklist, until nothing new turns up: the whole layer with its URL escapes replaced,
the whole layer with its Unicode escapes replaced, the whole layer without the breaks inside
wrapped base64, what each base64 stretch holds (also if
letters before it put it out of step), and, in all but the
outermost text, what each compressed stream holds. Each layer knows which characters of the outermost text its bytes come from, so what
is found in it is reported as a span there. A layer with the same bytes from the same places as
one before adds nothing and is left out; the same bytes from other places are unwrapped again.

Layers are unwrapped depth first, so that only a layer and those around it are held. What a stream holds
beyond WINDOW bytes is looked at in windows that overlap by half. Where that may not be the whole job (a run
without white space or a stream as long as half a window, or layers of more than MOST_DECODED bytes in
one document, as of a bomb) the document is marked: whole is false.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table, text_bytes

KINDS = ("assign", "access", "hex")
# Every secret is ASCII, so bytes are searched; bytes that are no UTF-8 match nothing.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ONE_ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Read as a string literal of C or Python, where a stream has short escapes besides those in hex.
LITERAL = re.compile(ONE_ESCAPE.pattern + rb"""|\\([abfnrtv0\\'"])""")
SHORT = dict(zip(b"abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
#: How gzip, zlib, bzip2, xz and zstandard streams begin.
STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
READ, PIECE = 1 << 16, 1 << 20
BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 cut into lines: all but the last are long, and what breaks them (with the next line's indent) is no part of it.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}(?:\\?\r?\n|\\r\\n|\\n)[\x20\t>]*)+[A-Za-z0-9+/_-]{2,}={0,2}(?![A-Za-z0-9+/_-])")
BREAK = re.compile(rb"(?:\\?\r?\n|\\r\\n|\\n)[\x20\t>]*")
#: Bytes of text, and how many bytes of a path may stand before a stream in base64.
PRINTED, LEAD = bytes([9, 10, 13, *range(32, 127)]), 256
#: Bytes that one document's layers may hold together before it is marked, and bytes of a stream to look at together.
MOST_DECODED, WINDOW = 1 << 30, 1 << 23
RUN = re.compile(rb"[^\x20\x09-\x0D]+")
DIGITS = np.full(256, 16, np.uint8)
for _d in b"0123456789abcdefABCDEF":
    DIGITS[_d] = int(chr(_d), 16)

#: For each escape of a layer, in order: start and end in the layer, start and end of what it comes from.
Escapes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Room:
    """What is left of the bytes that one document's layers may hold, and whether all of it was looked at."""

    def __init__(self, left: int):
        self.left, self.whole = left, True

    def take(self, n: int) -> bool:
        self.left -= n
        self.whole &= self.left >= 0
        return self.left >= 0


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the secrets of one layer."""
    found, low = [], raw.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return found


def _digest(*parts: object) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        b = p if isinstance(p, bytes) else p.tobytes() if isinstance(p, np.ndarray) else str(p).encode()
        h.update(b"%d:" % len(b) + b)
    return h.digest()


class Layer:
    """Decoded bytes. They come from an anchor (the outermost text, or what a base64 stretch or stream
    holds) with its escapes replaced; up(start, end) is the span of the outermost text for one of the anchor,
    and place tells anchors from other places apart."""

    def __init__(self, raw: bytes, up: Callable[[int, int], tuple[int, int]], place: bytes, escapes: Escapes | None = None, whole: tuple[int, int] | None = None, cut: bool = False):
        self.raw, self.up, self.place, self.escapes = raw, up, place, escapes
        #: The span of a base64 stretch, padding included.
        self.whole = whole
        #: Whether it lies in a window of a longer stream.
        self.cut = cut

    def anchored(self, start: int, end: int) -> tuple[int, int]:
        """The span of the anchor for one of this layer."""
        if self.escapes is None:
            return start, end
        c, e, p, q = self.escapes
        i, j = (int(k) for k in np.searchsorted(c, (start, end - 1), "right") - 1)
        if i >= 0:
            start = int(p[i]) if start < e[i] else int(q[i]) + start - int(e[i])
        if j >= 0:
            end = int(q[j]) if end - 1 < e[j] else int(q[j]) + end - int(e[j])
        return start, end

    def outer(self, start: int, end: int) -> tuple[int, int]:
        return self.up(*self.anchored(start, end))

    def replaced(self, raw: bytes, escapes: Escapes) -> Layer:
        """This layer with escapes replaced."""
        if self.escapes is None:
            return Layer(raw, self.up, self.place, escapes, cut=self.cut)
        (c, e, p, q), (oc, oe, op, oq) = escapes, self.escapes
        i, j = np.searchsorted(oc, p, "right") - 1, np.searchsorted(oc, q - 1, "right") - 1
        start = np.where(i < 0, p, np.where(p < oe[i], op[i], oq[i] + p - oe[i]))
        end = np.where(j < 0, q, np.where(q - 1 < oe[j], oq[j], oq[j] + q - oe[j]))
        # Escapes of this layer that no new one takes in move by what the new ones before them are shorter.
        k = np.searchsorted(p, oc, "right") - 1
        own = (k < 0) | (oc >= q[k])
        move = np.where(k < 0, 0, q[k] - e[k])
        parts = [(c, (oc - move)[own]), (e, (oe - move)[own]), (start, op[own]), (end, oq[own])]
        merged = [np.concatenate(x) for x in parts]
        order = np.argsort(merged[0], kind="stable")
        return Layer(raw, self.up, self.place, tuple(x[order] for x in merged), cut=self.cut)

    def places(self, start: int, end: int) -> tuple:
        """What decides where the bytes of a stretch come from."""
        s, t = self.anchored(start, end)
        if self.escapes is None:
            return self.place, s, t
        c, e, p, q = self.escapes
        i, j = np.searchsorted(e, start, "right"), np.searchsorted(c, end, "left")
        return (self.place, s, t) if i == j else (self.place, s, t, c[i:j] - start, e[i:j] - start, p[i:j] - s, q[i:j] - s)

    def key(self) -> bytes:
        return _digest(self.raw, *self.places(0, len(self.raw)))


def _url(raw: bytes) -> tuple[bytes, Escapes] | None:
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(a[:-2] == ord("%"))
    high, low = DIGITS[a[at + 1]], DIGITS[a[at + 2]]
    good = (high < 16) & (low < 16)
    at = at[good]
    if not len(at):
        return None
    out, keep = a.copy(), np.ones(len(a), bool)
    out[at] = high[good] * 16 + low[good]
    keep[at + 1] = keep[at + 2] = False
    c = at - 2 * np.arange(len(at))
    return out[keep].tobytes(), (c, c + 1, at, at + 3)


def _escapes(raw: bytes, kind: re.Pattern[bytes] = ONE_ESCAPE) -> tuple[bytes, Escapes] | None:
    """Codes below 256 stand for a byte each, which no search for ASCII can tell from UTF-8."""
    out, spans, at = bytearray(), [], 0
    for m in kind.finditer(raw):
        out += raw[at : m.start()]
        at = m.end()
        if kind is LITERAL and m[6]:
            code = SHORT[m[6][0]]
        else:
            code = int(next(g for g in m.groups()[:4] if g), 16) if m[5] is None else int(m[5])
        c = len(out)
        out += bytes([code]) if code < 256 else chr(code if code < 0x110000 else 0xFFFD).encode("utf-8", "surrogatepass")
        spans.append((c, len(out), m.start(), at))
    if not spans:
        return None
    return bytes(out + raw[at:]), tuple(np.array(spans, np.int64).T)


def _member(data: memoryview, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of what one stream holds, each with where the stream has been read to. Damage is an error."""
    read, start = READ, data[at]
    if start == 0x42:
        tool = bz2.BZ2Decompressor()
    elif start == 0xFD:
        tool = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    elif start == 0x28:
        import zstandard

        tool, read = zstandard.ZstdDecompressor().decompressobj(), 256  # it gives all that its input holds at once
    else:
        tool = zlib.decompressobj(47)
    buffer = b""
    while not tool.eof:
        if not buffer and getattr(tool, "needs_input", True):
            buffer = data[at : at + read]
            at += len(buffer)
        if start == 0x28:
            out, buffer, ended = tool.decompress(buffer), b"", not buffer
        else:
            given = len(buffer)
            out = tool.decompress(buffer, PIECE)
            ended = not given and not out and getattr(tool, "needs_input", True)
            buffer = getattr(tool, "unconsumed_tail", b"")
        if ended and not tool.eof:
            raise EOFError
        yield out, at - len(tool.unused_data)


def inflated(data: memoryview, at: int) -> Iterator[tuple[bytes, int]]:
    """As _member, with streams of the same kind that follow at once."""
    start = data[at]
    while True:
        for out, at in _member(data, at):
            yield out, at
        if at >= len(data) or data[at] != start or STREAM.match(data, at) is None:
            return


def extent(data: memoryview, at: int, most: int) -> tuple[int, int, bytes, bool]:
    """How much the stream at a place holds, where it ends, what it holds if that fits a window, and whether its
    end is within so many bytes (else the first two are what was read). Damage is an error."""
    n, out = 0, bytearray()
    for piece, end in inflated(data, at):
        n += len(piece)
        if n <= WINDOW:
            out += piece
        if n > most:
            return n, end, bytes(out), False
    return n, end, bytes(out), True


def windows(data: memoryview, at: int, most: int) -> Iterator[bytes]:
    """What the stream at a place holds, at most so many bytes, in windows that overlap by half."""
    held, n = bytearray(), 0
    for piece, _ in inflated(data, at):
        held += piece[: most - n]
        n += len(piece)
        while len(held) >= WINDOW:
            yield bytes(held[:WINDOW])
            del held[: WINDOW // 2]
        if n >= most:
            break
    yield bytes(held)


def _is_damage(e: Exception) -> bool:
    return isinstance(e, (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)) or type(e).__name__ == "ZstdError"


def _streams(layer: Layer, room: Room) -> Iterator[Layer]:
    raw, at = layer.raw, 0
    while (m := STREAM.search(raw, at)) is not None:
        start, at, data = m.start(), m.end(), memoryview(raw)
        most = max(room.left, 0)
        try:
            n, at, out, ends = extent(data, start, most)
        except Exception as e:
            if not _is_damage(e):
                raise
            # A stream that a window cuts off ends early.
            room.whole &= not (layer.cut and isinstance(e, EOFError))
            continue
        # A stream's bytes all depend on each other.
        whole = layer.whole if layer.whole and (start, at) == (0, len(raw)) else layer.outer(start, at)
        room.whole &= ends
        for part in [out] if n <= min(WINDOW, most) else windows(data, start, most):
            cut = layer.cut or n > WINDOW
            if cut and max((x.end() - x.start() for x in RUN.finditer(part)), default=0) >= WINDOW // 2:
                room.whole = False
            yield Layer(part, lambda *_, whole=whole: whole, _digest("stream", *whole), cut=cut)


def _sensible(data: bytes, lead: int) -> bool:
    """Whether bytes look decoded in the right step: a stream begins among the first ones, or the second half is text."""
    tail = data[len(data) // 2 :]
    return STREAM.search(data, 0, lead + 10) is not None or len(tail.translate(None, PRINTED)) * 10 <= len(tail)


def _unwrapped(raw: bytes) -> tuple[bytes, Escapes] | None:
    """The layer without the breaks inside wrapped base64: each is an escape that stands for nothing."""
    out, spans, at = bytearray(), [], 0
    for m in WRAPPED.finditer(raw):
        for x in BREAK.finditer(raw, m.start(), m.end()):
            out += raw[at : x.start()]
            at = x.end()
            spans.append((len(out), len(out), x.start(), at))
    if not spans:
        return None
    return bytes(out + raw[at:]), tuple(np.array(spans, np.int64).T)


def _base64(layer: Layer, start: int, stretch: bytes) -> Layer | None:
    bare = stretch.rstrip(b"=")
    if bare.islower() or bare.isdigit():
        return None
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]  # a character too many says nothing
    try:
        data = base64.b64decode(bare.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None
    end = start + len(stretch)

    def up(a: int, b: int) -> tuple[int, int]:
        return layer.outer(start + a * 8 // 6, min(end, start + (b * 8 - 1) // 6 + 1))

    return Layer(data, up, _digest("base64", *layer.places(start, end)), whole=layer.outer(start, end), cut=layer.cut)


def unwrap(layer: Layer, room: Room) -> Iterator[Layer]:
    """The layers directly inside this one."""
    raw = layer.raw
    if b"%" in raw and (got := _url(raw)) is not None:
        yield layer.replaced(*got)
    if (b"\\" in raw or b"&#" in raw) and (got := _escapes(raw)) is not None:
        yield layer.replaced(*got)
    if b"\\x" in raw and (got := _escapes(raw, LITERAL)) is not None:
        yield layer.replaced(*got)
    if (b"\n" in raw or b"\\n" in raw) and (got := _unwrapped(raw)) is not None:
        yield layer.replaced(*got)
    for m in BASE64.finditer(raw):
        if (inner := _base64(layer, m.start(), m[0])) is None:
            continue
        yield inner
        if not _sensible(inner.raw, 1):
            # Letters that stand before base64 without a gap, as those of a path do, put it out of step.
            for skip in range(1, min(4, len(m[0]) - 15)):
                if (inner := _base64(layer, m.start() + skip, m[0][skip:])) is not None and _sensible(inner.raw, LEAD):
                    yield inner
    if layer.place or layer.escapes is not None:
        yield from _streams(layer, room)


def _in_characters(raw: bytes, *lists: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Spans of bytes as spans of characters. Both ends are beside ASCII, where even bytes that are no UTF-8 can be cut."""
    if raw.isascii():
        return [*lists]
    at, n, number = 0, 0, {}
    for x in sorted({x for spans in lists for s, _, e in spans for x in (s, e)}):
        n += len(raw[at:x].decode("utf-8", "replace"))
        at, number[x] = x, n
    return [[(number[s], k, number[e]) for s, k, e in spans] for spans in lists]


def unwrapped(raw: bytes, most: int = MOST_DECODED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """(base spans, all spans, whether the text was unwrapped to the end) of a text in UTF-8, spans as (start, index of the kind, end), in order."""
    base = sorted(scan(raw))
    every, seen, room = set(base), set(), Room(most)
    work = [unwrap(Layer(raw, lambda *span: span, b""), room)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.raw or (mark := layer.key()) in seen or not room.take(len(layer.raw)):
            continue
        seen.add(mark)
        every.update((s, k, e) for (a, k, b) in scan(layer.raw) for s, e in [layer.outer(a, b)])
        work.append(unwrap(layer, room))
    return *_in_characters(raw, base, sorted(every)), room.whole


def secrets(text: str, raw: bytes | None = None, most: int = MOST_DECODED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, index of the kind, end), in order."""
    return unwrapped(text.encode("utf-8", "replace") if raw is None else raw, most)[:2]


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base (array of kind, start, end), spans (array, those of inner layers included), whole of every row of docs.

    A null text is empty and has no spans. A null doc_id stays null. Repeated rows give repeated
    results; an empty table an empty one. whole is false where layers may be left (see above). Spans count code points; ends are exclusive.
    """
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_bytes(text).alias("body"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unwrapped(x) for x in b.column("body").to_pylist()]
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found], span) for i in range(2)]
            whole = pa.array([f[2] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, whole], names=["doc_id", "base", "spans", "whole"])

    kind = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    return source.mapInArrow(run, source.drop("body").schema.add("base", kind).add("spans", kind).add("whole", "boolean"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint) AS n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), "whole")


QUERIES = {"op7_secret_scan": op7_secret_scan}
