"""Secret scan with a recursive decoding worklist.

A document's text is the first layer.  Every layer is scanned for the three
kinds of secrets and for encoded content; what decodes becomes a new layer on
the worklist, until nothing new decodes:

* escapes: URL (``%41``) and Unicode ones (``\\u0041``, ``\\x41``,
  ``\\u{41}``), and in decoded layers text of two bytes a character; all escapes
  of a layer are replaced at once, so a layer has one such layer below it, and
  mixed levels don't multiply;
* base64 runs (either alphabet, 16 characters and more), also wrapped in lines,
  at each of the four places where a group may begin, since a run can be glued
  to a path or a name before it;
* gzip (with all its members), zlib, bzip2 and xz data anywhere in a decoded
  layer, so compressed in compressed and percent-encoded data, too.

Decoded layers hold a character for each byte: secrets are ASCII, so what else
the bytes may mean doesn't matter, and text beside bytes that are none is read.

A layer knows where each of its characters comes from, so a secret found at
any depth is reported as a span of the document (code points, end exclusive).
A layer is entered once: one of the same characters from the same place of the
document, on whatever way it was reached, is known already.  So cycles end.

Decompressed data are never held whole: they are scanned in pieces that end at a
character which no secret and no encoded run can hold, so nothing is cut.  All
layers that need no decompression come first, then each compressed run of them
with a bound of its own (``STREAM_X``): at the first depth no gzip or zlib data can
meet it.  Bounds that remain stop compression bombs, escapes nested thousands deep
and pieces without an end (``max_expanded``).  Each holds for one encoded run of
the text, so that no run takes from another; a document that meets one is reported
with ``complete`` false, and redaction marks all of that run.

Cases: a null text counts as empty; a text without secrets has empty ``spans``;
long texts are scanned whole; repeated rows are scanned each; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmill.llm.durable import map_texts, parts

KINDS = ("assign", "access", "hex")
#: What the layers under one encoded run may hold together: so much, or so many times the text if that is more.  A piece of decompressed data may be as long.
MAX_EXPANDED, EXPANDED_X = 64 << 20, 16
#: What a layer is charged besides its characters.
LAYER_COST = 1 << 12
#: What a compressed run and all under it may hold together: so many MAX_EXPANDED, or so many times the run (deflate reaches 1032).
STREAMS, STREAM_X = 16, 1100
#: Bytes that are decompressed at once, and that are scanned again where a piece has no end.
BLOCK, OVERLAP = 1 << 20, 1 << 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_PARTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: The same, or a run of ASCII characters of two bytes each, low byte first or last.
_ESCAPE_OF_BYTES = re.compile(_ESCAPE.pattern + r"|(?:[\t\n\r\x20-\x7e]\x00){4,}|(?:\x00[\t\n\r\x20-\x7e]){4,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)?={0,2}")
_STANDARD = str.maketrans("-_", "+/")
#: What a secret or anything encoded takes at least, as it stands in decoded bytes; other bytes need no layer.
_WORTH = re.compile(rb"[\t\n\r\x20-\x7e]{12}|(?:[\x20-\x7e]\x00){12}|(?:\x00[\x20-\x7e]){12}|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
#: Bytes that a match of the patterns above can hold, or a character of more bytes.
_INSIDE = bytes(i for i in range(256) if i > 127 or chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"':%\\{} \t\r\n\0")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that meet their length, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_PARTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


class Layer:
    """A text, and for decoded ones which span of the parent's text is behind each of its own."""

    def __init__(self, text: str, parent: Layer | None = None):
        self.text, self.parent = text, parent

    def above(self, start: int, end: int) -> tuple[int, int]:
        """The parent's span of text[start:end]."""
        return start, end

    def new(self, start: int, end: int) -> bool:
        """Whether text[start:end] holds anything that the parent's text doesn't."""
        return True

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The document span of text[start:end]."""
        layer = self
        while layer.parent is not None:
            start, end = layer.above(start, end)
            layer = layer.parent
        return start, end


class Escaped(Layer):
    """The parent's text with its escapes replaced.

    Pieces begin at ``at``; plain ones map character by character, decoded ones
    have ``width`` source characters for each of theirs.
    """

    def __init__(self, parent: Layer, of_bytes: bool):
        parts: list[str] = []
        self.at: list[int] = []
        self.origin: list[int] = []
        self.width: list[int] = []
        size = last = 0
        source = parent.text

        def add(text: str, origin: int, width: int) -> None:
            nonlocal size
            if text:
                parts.append(text)
                self.at.append(size)
                self.origin.append(origin)
                self.width.append(width)
                size += len(text)

        for m in (_ESCAPE_OF_BYTES if of_bytes else _ESCAPE).finditer(source):
            s = m[0]
            if "\0" in s:
                out = s[1::2] if s[0] == "\0" else s[::2]
            else:
                value = int(s[1:] if s[0] == "%" else s[3:-1] if s[2] == "{" else s[2:], 16)
                if value >= 0x110000 or 0xD800 <= value < 0xE000:
                    continue  # Halves of a pair are no ASCII; they stay as they are written.
                out = chr(value)
            add(source[last : m.start()], last, 0)
            add(out, m.start(), len(s) // len(out))
            last = m.end()
        if last:
            add(source[last:], last, 0)
        super().__init__("".join(parts), parent)

    def above(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return self.origin[a] + (start - self.at[a]) * (self.width[a] or 1), self.origin[b] + (end - self.at[b]) * (self.width[b] or 1)

    @property
    def plain(self) -> bool:
        """Whether the text is one without control characters."""
        return not _CONTROL.search(self.text.encode("latin-1", "replace"))

    def new(self, start: int, end: int) -> bool:
        a, b = bisect_right(self.at, max(0, start)) - 1, bisect_right(self.at, end - 1) - 1
        return any(self.width[a : b + 1])


class Decoded(Layer):
    """The bytes of a base64 run: three of them for four of the characters at ``places``."""

    def __init__(self, parent: Layer, data: bytes, places: range | list[int], end: int):
        super().__init__(data.decode("latin-1"), parent)
        self.data, self.places, self.end = data, places, end

    def above(self, start: int, end: int) -> tuple[int, int]:
        first, last = self.places[start // 3 * 4 + start % 3], (end - 1) // 3 * 4 + (end - 1) % 3 + 1
        return first, self.end if end == len(self.text) else self.places[last] + 1

    @property
    def plain(self) -> bool:
        """Whether the bytes are UTF-8 without control characters."""
        if _CONTROL.search(self.data):
            return False
        try:
            self.data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True


class Unpacked(Layer):
    """A piece of what the compressed data at start..end of the parent's text hold."""

    def __init__(self, parent: Layer, text: str, start: int, end: int):
        super().__init__(text, parent)
        self.start, self.end = start, end

    def above(self, start: int, end: int) -> tuple[int, int]:
        return self.start, self.end


def _decoded(layer: Layer, chars: str, places: range | list[int], end: int) -> Iterator[Decoded]:
    """A run's bytes from each of the places where a group may begin, up to one that gives text or compressed data."""
    for skip in range(min(4, len(chars) - 1)):
        body = chars[skip : len(chars) - (len(chars) - skip) % 4]
        rest = (len(chars) - skip) % 4
        if rest > 1:
            body += chars[len(chars) - rest :] + "A" * (4 - rest)
        data = binascii.a2b_base64(body)
        if rest > 1:
            data = data[: rest - 4]
        if _WORTH.search(data):
            found = Decoded(layer, data, places[skip:], end)
            yield found
            if found.plain or _begins(memoryview(data)):
                return


def _base64_layers(layer: Layer) -> Iterator[Decoded]:
    text = layer.text
    for m in _BASE64.finditer(text):
        if layer.new(m.start() - 1, m.end() + 1):
            run = m[0].rstrip("=")
            yield from _decoded(layer, run.translate(_STANDARD), range(m.start(), m.start() + len(run)), m.end())
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            if "\n" in m[0] and layer.new(m.start() - 1, m.end() + 1):
                places = [i for i in range(m.start(), m.end()) if text[i] not in "\r\n\t ="]
                yield from _decoded(layer, "".join([text[i] for i in places]).translate(_STANDARD), places, m.end())


class _Budget:
    """What may still be expanded; what a part of it takes counts for the whole, too."""

    def __init__(self, left: int, whole: _Budget | None = None):
        self.left, self.whole, self.met = left, whole, False

    def take(self, n: int) -> bool:
        if n > self.left:
            b: _Budget | None = self
            while b is not None:
                b.met, b = True, b.whole
            return False
        b = self
        while b is not None:
            b.left, b = b.left - n, b.whole
        return True

    def half(self, _: int) -> _Budget:
        return _Budget(self.left // 2, self)


def _unpacker(data: bytes | memoryview):
    """What decompresses data that begin like gzip, zlib, bzip2 or xz."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return None


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)


def _begins(data: memoryview) -> bool:
    """Whether compressed data begin here: so they do if some of them decompress."""
    unpacker = _unpacker(data)
    try:
        return unpacker is not None and (bool(unpacker.decompress(data[:4096], 64)) or unpacker.eof or (len(data) > 4096 and bool(unpacker.decompress(data[4096 : 1 << 20], 64))))
    except _BROKEN:
        return False


class _Stream:
    """Compressed data at the beginning of ``data``, all members of them."""

    def __init__(self, data: memoryview):
        self.data = data
        #: Bytes that belong to the members that are through; whether the data end inside of a member.
        self.used, self.open = 0, False

    def blocks(self) -> Iterator[bytes]:
        """The decompressed data, BLOCK bytes at most at once; they end where the data are broken."""
        while self.used < len(self.data):
            rest = self.data[self.used :]
            if self.used and not _begins(rest):
                return
            unpacker = _unpacker(rest)
            try:
                for i in range(0, len(rest), 1 << 16):
                    more: bytes | memoryview = rest[i : i + (1 << 16)]
                    while not unpacker.eof:
                        out = unpacker.decompress(more, BLOCK)
                        if out:
                            yield out
                        more = getattr(unpacker, "unconsumed_tail", b"")
                        if not more and len(out) < BLOCK and getattr(unpacker, "needs_input", True):
                            break
                    if unpacker.eof:
                        self.used += min(i + (1 << 16), len(rest)) - len(unpacker.unused_data)
                        break
                else:
                    self.open = True
                    return
            except _BROKEN:
                return

    def length(self, limit: int) -> int:
        """Bytes that the compressed data take; all there are if they end early, are broken or hold more than ``limit``."""
        for block in self.blocks():
            limit -= len(block)
            if limit < 0:
                self.open = True
                break
        return len(self.data) if self.open or not self.used else self.used


def _open(piece: bytes) -> bool:
    """Whether compressed data begin in a piece that go on behind it."""
    view = memoryview(piece)
    for m in _PACKED.finditer(piece):
        if _begins(view[m.start() :]):
            stream = _Stream(view[m.start() :])
            stream.length(MAX_EXPANDED)
            if stream.open:
                return True
    return False


def _pieces(data: memoryview, longest: int, budget: _Budget) -> Iterator[bytes]:
    """The decompressed data in pieces that end where nothing that is looked for can go on."""
    held: list[bytes] = []
    size = 0
    for block in _Stream(data).blocks():
        if not budget.take(len(block)):
            break
        end = len(block.rstrip(_INSIDE)) if size + len(block) >= min(BLOCK, longest) else 0
        held.append(block[:end] if end else block)
        if end and size < longest and _open(b"".join(held)):
            held[-1], end = block, 0
        size += len(held[-1])
        if not end and size > longest:
            budget.met, end = True, len(block)
            piece = b"".join(held)
            yield piece
            held, size = [piece[-OVERLAP:]], OVERLAP
        elif end:
            yield b"".join(held)
            held, size = [block[end:]], len(block) - end
    if size:
        yield b"".join(held)


class _Scan:
    """Spans, decoded layers, and the spans of encoded runs that met a bound."""

    def __init__(self, text: str, max_expanded: int):
        self.base = base_spans(text)
        self.every = set(self.base)
        self.unread: list[tuple[int, int]] = []
        self.layers = 0
        self.longest = max_expanded
        self.known: set[tuple[bytes, int, int]] = set()
        self.packed: deque[tuple[Layer, bytes, int]] = deque()
        root = Layer(text)
        for x in self._below(root):
            budget = _Budget(max(max_expanded, EXPANDED_X * len(text)))
            self._settle(x, budget)
            if budget.met:
                self.unread.append(x.up(0, len(x.text)) if isinstance(x, Decoded) else _changed(x))
        for layer, raw, at in self._drained():
            self._unpack(layer, raw, at, lambda size: _Budget(max(STREAMS * max_expanded, STREAM_X * size)))

    def _below(self, layer: Layer) -> Iterator[Layer]:
        """What decodes in a layer, but for compressed data."""
        of_bytes = layer.parent is not None
        if "%" in layer.text or "\\" in layer.text or (of_bytes and "\0" in layer.text):
            found = Escaped(layer, of_bytes)
            if found.text:
                yield found
        yield from _base64_layers(layer)

    def _settle(self, first: Layer, budget: _Budget) -> None:
        """Scan a layer and all that decodes in it; where compressed data begin goes to ``packed``."""
        work = deque([first])
        while work:
            layer = work.popleft()
            key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.up(0, len(layer.text)))
            if key in self.known:
                continue
            if not budget.take(len(layer.text) + LAYER_COST):
                return
            self.known.add(key)
            before = len(self.every)
            for start, kind, end in base_spans(layer.text):
                s, e = layer.up(start, end)
                self.every.add((s, kind, e))
            raw = layer.data if isinstance(layer, Decoded) else layer.text.encode("latin-1", "replace")
            at = self._next(layer, raw, 0)
            if at >= 0:
                self.packed.append((layer, raw, at))
            if not isinstance(layer, Unpacked) and (len(self.every) > before or (at < 0 and layer.plain)):
                # Bytes that tell nothing are no layer worth counting; pieces of compressed data are counted as one.
                self.layers += 1
            work.extend(self._below(layer))

    def _next(self, layer: Layer, raw: bytes, at: int) -> int:
        """Where compressed data begin in a layer's bytes, from ``at`` on; -1 if nowhere."""
        view = memoryview(raw)
        for m in _PACKED.finditer(raw, at):
            if layer.new(m.start(), m.start() + 2) and _begins(view[m.start() :]):
                return m.start()
        return -1

    def _drained(self) -> Iterator[tuple[Layer, bytes, int]]:
        while self.packed:
            yield self.packed.popleft()

    def _unpack(self, layer: Layer, raw: bytes, at: int, budget_of: Callable[[int], _Budget]) -> None:
        """Scan all compressed data of a layer, from those at ``at`` on."""
        while at >= 0:
            data = memoryview(raw)[at:]
            budget = budget_of(len(data))
            stream = _Stream(data)
            size = stream.length(budget.left)
            outer, self.packed, counted = self.packed, deque(), False
            for piece in _pieces(data[:size], self.longest, budget):
                known = len(self.known)
                self._settle(Unpacked(layer, piece.decode("latin-1"), at, at + size), budget)
                # All pieces of a run are one layer.
                if not counted and len(self.known) > known:
                    self.layers, counted = self.layers + 1, True
                for inner in self._drained():
                    # Half of what is left, so that it leaves something to what comes after.
                    self._unpack(*inner, budget.half)
            self.packed = outer
            if budget.met:
                self.unread.append(layer.up(at, at + size))
            at = self._next(layer, raw, at + (size if stream.open or stream.used else 2))


def _changed(x: Escaped) -> tuple[int, int]:
    """The document span of all that an escape layer decoded."""
    at = [i for i, w in enumerate(x.width) if w]
    end = x.at[at[-1] + 1] if at[-1] + 1 < len(x.at) else len(x.text)
    return x.up(x.at[at[0]], end)


def scan(text: str | None, max_expanded: int = MAX_EXPANDED) -> tuple[list[Span], list[Span], int, bool]:
    """(base spans, all spans, decoded layers, complete) of one text."""
    done = _Scan(text or "", max_expanded)
    return done.base, sorted(done.every), done.layers, not done.unread


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, complete boolean"


def scan_documents(docs: DataFrame, max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers, complete); no shuffle.

    The counts and base_sha256 tell of the text itself; ``spans`` also has what
    decoded layers hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [scan(x, max_expanded) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(s[1] == k for s in base) for base, *_ in found], pa.int64()) for k in range(3)],
                    pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, *_ in found], pa.string()),
                    pa.array([_joined(every) for _, every, *_ in found], pa.string()),
                    pa.array([x[2] for x in found], pa.int64()),
                    pa.array([x[3] for x in found], pa.bool_()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "complete"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def redact(text: str | None, mark: str = "[SECRET]", max_expanded: int = MAX_EXPANDED) -> str | None:
    """The text with every span, decoded ones included, replaced by a mark; touching spans become one.

    Encoded runs that met a bound were not read to their end and are replaced whole.
    """
    if not text:
        return text
    out, at = [], 0
    done = _Scan(text, max_expanded)
    spans = sorted(done.every | {(start, len(KINDS), end) for start, end in done.unread})
    i = 0
    while i < len(spans):
        start, end = spans[i][0], spans[i][2]
        while i + 1 < len(spans) and spans[i + 1][0] <= end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], mark]
        at = end
        i += 1
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``n_chars`` (if there) set to the new length."""
    columns = docs.columns

    def run(batches: Iterator[tuple[pa.RecordBatch, int]]) -> Iterator[pa.RecordBatch]:
        for batch, at in batches:
            new = pa.array([redact(x, mark) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = map_texts(docs, run)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in columns])
