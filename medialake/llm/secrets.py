"""Secret scans by a recursive decoding worklist.

A text is scanned as it is; then every encoded part that is found in it (URL escapes, Unicode
escapes and character references, base64, and hex or base64 that hides compressed bytes) is
decoded to a layer of its own, scanned, and searched for further encoded parts, until nothing
new appears.  A layer that several places hold is scanned once, so cycles end, but what it
shows is carried up to every one of these places: each character of a layer carries the span of
the layer above that it came from, so what is found at any depth is reported in the original's
code points.  Base64 and hex runs are decoded at each phase, and where a run is not text as a
whole (for something stands before or after it without a space), every stretch of ASCII text and
every compressed stream in it is a layer.  Runs that only line breaks part are decoded joined as
well, beside each by itself, so a list of values and a wrapped value are both read; in such a
block a span may end at a line's end and another of the same start go on.

Escapes that stand in each other are decoded to their own fixpoint where they stand, as far as they
give ASCII (%252541 is A in one layer, with the span of the whole chain; the stages between are no layers), so
texts of nested escapes cost what they are long.

Everything happens inside one row, in a pass without a shuffle.  Compressed streams are read to
their end, member after member, and through streams in streams; they are inflated piece by
piece and scanned in chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``, so memory is bounded
whatever they inflate to, and only what is longer than the overlap and lies across a border can
be seen in two parts (a stream that holds itself is opened once).  A stream that breaks off or is
damaged is read as far as it goes.

Defined results: NULL and empty texts have no spans (counts 0, empty strings, the digest of the
empty string); spans found twice are reported once; ids pass through whatever they are.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
CHUNK, OVERLAP, PIECE = 1 << 22, 1 << 18, 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_KEYWORD = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # a maximal run of 24 or more is a run of 24 or more
_URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
                     r"|&[A-Za-z]{2,8};")
_ONE = re.compile("%[0-9A-Fa-f]{2}|" + _ESCAPE.pattern)
_LONGEST = 10  # characters of an escape
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_LAST = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?![A-Za-z0-9+/_=-])")
_HEXBYTES = re.compile(r"(?:[0-9A-Fa-f]{2}){12,}")

#: Every secret, and every encoded part that hides one, has 12 ASCII characters or more in a row.
_STRETCH = re.compile(rb"[\x00-\x7f]{12,}")
_ZLIB = b"|".join(re.escape(bytes((a, b))) for a in range(8, 128, 16) for b in range(256)
                  if (a << 8 | b) % 31 == 0 and not b & 32)
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|" + _ZLIB)

Place = Callable[[int, int], tuple[int, int]]  # a span of a layer as a span of the layer above
Layer = tuple[str, Place]


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret of the three kinds in ``text``, per kind left to right."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _fixed(start: int, end: int) -> Place:
    return lambda a, b: (start, end)


def _nested(around: str, border: int, last: int) -> tuple[int, int, str] | None:
    """The first escape in ``around`` that takes in the character before ``border``, of the ``last``
    ones before it that are newly decoded, and decodes to ASCII: where it starts and ends, and its character."""
    for at in range(max(0, border - _LONGEST), border):
        if around[at] in "%&\\" and (m := _ONE.match(around, at)) and m.end() > border - last:
            new = _escape(m.group()) if around[at] != "%" else chr(int(m.group()[1:], 16))
            if new is not None and new != m.group() and new.isascii():
                return at, m.end(), new
    return None


def _replaced(text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The text with every match replaced by its decoding; its other characters stay.

    What a decoding completes to a further ASCII escape, with the characters beside it, is
    decoded at once, so a chain of nested escapes (%252525, &amp;amp;) is one layer and costs
    what it is long, not its square.
    """
    parts: list[list] = []  # text, start and end in the layer above; no end: the characters are themselves
    at = 0
    while m := pattern.search(text, at):
        new, end = decode(m.group()), m.end()
        if new is None or new == m.group():
            parts.append([text[at:end], at, None])
            at = end
            continue
        if m.start() > at:
            parts.append([text[at:m.start()], at, None])
        parts.append([new, m.start(), end])
        while True:
            tail = ""
            for part in reversed(parts):
                tail = part[0][-_LONGEST:] + tail
                if len(tail) >= _LONGEST:
                    break
            tail = tail[-_LONGEST:]
            found = _nested(tail + text[end:end + _LONGEST], len(tail), len(parts[-1][0]))
            if found is None:
                break
            first, last, one = found
            drop, start = len(tail) - first, end
            while drop > 0:
                part = parts[-1]
                cut = min(drop, len(part[0]))
                drop -= cut
                start = part[1] + (len(part[0]) - cut if part[2] is None else 0)
                if cut == len(part[0]):
                    parts.pop()
                else:
                    part[0] = part[0][:-cut]
            end += max(last - len(tail), 0)
            kept = tail[last:] if last < len(tail) else ""
            parts.append([one + kept, start, end])
        at = end
    if at == 0 or all(end is None for _, _, end in parts):
        return None
    parts.append([text[at:], at, None])
    starts = list(itertools.accumulate((len(part[0]) for part in parts[:-1]), initial=0))
    above = [(start, end) for _, start, end in parts]

    def place(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        (start, fixed), (last, end) = above[i], above[j]
        return start if fixed else start + a - starts[i], end or last + b - starts[j]
    return "".join(part[0] for part in parts), place


def _url(run: str) -> str | None:
    try:
        return unquote_to_bytes(run).decode("utf-8")
    except UnicodeDecodeError:
        return unquote_to_bytes(run).decode("latin-1")


def _escape(code: str) -> str | None:
    if code[0] == "&":
        new = html.unescape(code)
        return None if new == code else new
    try:
        return chr(int(code[2:], 16))
    except (ValueError, OverflowError):
        return None


class Inflated:
    """The compressed members (gzip, zlib, bzip2, xz) that follow each other at the start of ``blocks``,
    piece by piece; ``read`` is how many bytes the members read to their end had, ``rest`` what of the
    blocks taken follows them."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.read, self.rest = blocks, 0, b""

    def _opened(self, head: bytes):
        if head[:2] == b"\x1f\x8b":
            return zlib.decompressobj(wbits=31)
        if head[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else zlib.decompressobj()

    def __iter__(self) -> Iterator[bytes]:
        data, taken = b"", 0
        while True:
            while len(data) < 6 and (block := next(self.blocks, b"")):
                data += block
                taken += len(block)
            if not _MAGIC.match(data):
                self.rest = data
                return
            one = self._opened(data)
            try:
                while not one.eof:
                    piece = one.decompress(data, PIECE)
                    data = getattr(one, "unconsumed_tail", b"")  # the others keep it themselves
                    if piece:
                        yield piece
                    elif not data and not one.eof:
                        data = next(self.blocks, b"")
                        taken += len(data)
                        if not data:
                            return
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            data = one.unused_data
            self.read, self.rest = taken - len(data), data


def _chunks(pieces: Iterator[bytes], chain: tuple[bytes, ...]) -> Iterator[tuple[bytes, tuple[bytes, ...]]]:
    """Overlapping chunks of what ``pieces`` hold, each with the beginnings of the streams it is in.
    A stream that is longer than a chunk is inflated on the way; in others it is found later."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) >= CHUNK:
            break
    if len(held) >= CHUNK and _MAGIC.match(held) and (head := bytes(held[:OVERLAP])) not in chain:
        stream = Inflated(itertools.chain((bytes(held),), pieces))
        chain = (*chain, head)
        yield from _chunks(iter(stream), chain)
        if stream.read:
            held = bytearray(stream.rest)
    for piece in itertools.chain((b"",), pieces):
        held += piece
        if len(held) >= CHUNK:
            yield bytes(held), chain
            del held[:-OVERLAP]
    if held:
        yield bytes(held), chain


def _as_text(data: bytes) -> str | None:
    """Bytes that are text as a whole, or None."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and shown >= 0.9 * len(text) else None


def _texts(data: bytes, chain: tuple[bytes, ...] = ()) -> Iterator[tuple[str, int, int, bool]]:
    """The texts in ``data``, each with the bytes it is in and whether it is these bytes themselves
    (not what they hold compressed)."""
    if (text := _as_text(data)) is not None:
        yield text, 0, len(data), True
        return
    for m in _STRETCH.finditer(data):
        yield m.group().decode("utf-8"), m.start(), m.end(), True
    at = 0
    while m := _MAGIC.search(data, at):
        at = m.start() + 1
        head = data[m.start():m.start() + OVERLAP]
        if head in chain:
            continue
        stream = Inflated(data[i:i + PIECE] for i in range(m.start(), len(data), PIECE))
        for chunk, inner in _chunks(iter(stream), (*chain, head)):
            for text, _, _, _ in _texts(chunk, inner):
                yield text, m.start(), len(data), False
        at = max(at, m.start() + stream.read)


def _runs(text: str) -> Iterator[tuple[str, list[int] | int, int, bool]]:
    """Base64 runs: characters, where each is (or the first, if they follow each other), the end of
    the last with its padding, and whether the run is a line of several."""
    lines: list[tuple[int, int]] = []

    def block():
        if lines and (m := _LAST.match(text, lines[-1][1])) and text[lines[-1][1] - 1] != "=":
            lines.append(m.span(1))
        for start, end in lines:
            if end - start >= 16:
                yield text[start:end].rstrip("="), start, end, len(lines) > 1
        if len(lines) > 1:
            bare = [(start, start + len(text[start:end].rstrip("="))) for start, end in lines]
            yield ("".join(text[i:j] for i, j in bare), [k for i, j in bare for k in range(i, j)], lines[-1][1], True)
        lines.clear()

    for m in _BASE64.finditer(text):
        if lines and (text[lines[-1][1] - 1] == "="
                      or (gap := _BREAK.match(text, lines[-1][1])) is None or gap.end() != m.start()):
            yield from block()
        lines.append(m.span())
    yield from block()


def _in_run(length: int, where: list[int] | int, end: int, skip: int, size: int) -> Place:
    """Where a run's characters are that hold bytes a to b of its decoding from ``skip`` on."""
    def char(i: int) -> int:
        return where + i if isinstance(where, int) else where[i]
    return lambda a, b: (char(skip + a // 3 * 4),
                         end if b == size else char(min(skip + -(-b // 3) * 4, length) - 1) + 1)


def _base64_layers(text: str) -> Iterator[Layer]:
    for chars, where, end, listed in _runs(text):
        raw = chars.replace("-", "+").replace("_", "/")
        # A run may begin with what stands before it without a space: try each phase.
        for skip in range(min(4, len(raw))):
            body = raw[skip:]
            body = body[:len(body) - 1] if len(body) % 4 == 1 else body
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except binascii.Error:
                continue
            of_bytes = _in_run(len(chars), where, end, skip, len(data))
            for inner, a, b, itself in _texts(data):
                if itself and (listed or b - a < len(data)):
                    yield inner, _stretched(inner, a, of_bytes)
                else:
                    yield inner, _fixed(*of_bytes(a, b))


def _stretched(inner: str, first: int, of_bytes: Place) -> Place:
    """For a text of bytes that start at ``first``: each character in the bytes that it is."""
    if inner.isascii():
        return lambda a, b: of_bytes(first + a, first + b)
    return lambda a, b: of_bytes(first + len(inner[:a].encode()), first + len(inner[:b].encode()))


def _hex_layers(text: str) -> Iterator[Layer]:
    for m in _HEXBYTES.finditer(text):
        for inner, a, b, itself in _texts(data := bytes.fromhex(m.group())):
            start = m.start()
            if itself and b - a < len(data):
                yield inner, _stretched(inner, a, lambda a, b, start=start: (start + 2 * a, start + 2 * b))
            else:
                yield inner, _fixed(start + 2 * a, start + 2 * b)


def _unwrapped(text: str) -> Iterator[Layer]:
    """The layers directly below: one with all URL escapes decoded, one with all Unicode
    escapes, and one for each text that a base64 or hex run holds."""
    if "%" in text and (new := _replaced(text, _URL, _url)):
        yield new
    if ("\\" in text or "&" in text) and (new := _replaced(text, _ESCAPE, _escape)):
        yield new
    yield from _base64_layers(text)
    yield from _hex_layers(text)


def _key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each sorted, as (start, kind, end)."""
    if not text:
        return [], []
    base = sorted(find_spans(text))
    root = _key(text)
    spans, holders, work = {root: set(base)}, defaultdict(list), [(root, _unwrapped(text))]
    while work:  # depth first: only the layers of one chain are held
        above, layers = work[-1]
        layer = next(layers, None)
        if layer is None:
            work.pop()
            continue
        key = _key(layer[0])
        holders[key].append((above, layer[1]))
        if key not in spans:
            spans[key] = set(find_spans(layer[0]))
            work.append((key, _unwrapped(layer[0])))
    # What a layer shows is shown at each place that holds it, until nothing new comes up.
    news = [(key, set(found)) for key, found in spans.items() if found and key in holders]
    while news:
        key, found = news.pop()
        for above, place in holders[key] if key in holders else ():
            more = set()
            for start, kind, end in found:
                first, last = place(start, end)
                more.add((first, kind, last))
            more -= spans[above]
            if more:
                spans[above] |= more
                news.append((above, more))
    return base, sorted(spans[root])


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("_text"):
            base, spans = scan(t.as_py())
            listed = _joined(base)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                         hashlib.sha256(listed.encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(cols, types)]],
            [*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"])


def scan_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_assign, n_access, n_hex, base_sha256, spans and n_decoded (spans
    that only a decoded layer shows)."""
    rows = docs.select(*keep, docs[text].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scan_batches, f"{fields}, n_assign long, n_access long, n_hex long, "
                                          "base_sha256 string, spans string, n_decoded long")
