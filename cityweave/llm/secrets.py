"""Secret scans by a recursive decoding worklist.

Each text is scanned as it stands (the base spans).  Then layers are unwrapped:
percent escapes, Unicode, octal and character-reference escapes (by number or name) are
decoded over the whole layer, base64 runs are decoded on their own, as UTF-8 and as
UTF-16, and compressed payloads (gzip, zlib, bzip2) inside them are inflated.  Raw
deflate has no head that tells it from other bytes and is not opened.  Each new layer is scanned and put back
on the worklist until nothing new appears; a layer whose text was met before
from the same place of the original is not opened again.  Every position of a layer keeps the range of code points
of the original text that it came from, so spans are always given in the
original.

Null and empty texts give no spans.  Long texts and payloads are decoded in pieces,
cut where nothing that is looked for can cross, so no layer is left out for its
size.  A base64 token that is glued to other characters of its alphabet is
decoded with them: the span found in it may end a few characters late.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# The secret patterns, as (kind, pattern, least length, group that the length counts).
PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
)
KINDS = {kind: i for i, (kind, *_) in enumerate(PATTERNS)}
#: Characters that are decoded at a time.
PIECE = 1 << 20

_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([0-3][0-7]{2})|&([A-Za-z][A-Za-z0-9]{1,30};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_BREAK = re.compile(r"[ \t\r\n]+")
_URL_SAFE = str.maketrans("-_", "+/")
_HEAD = re.compile(rb"[\x08\x18\x28\x38\x48\x58\x68\x78\x1f]|BZh")
#: Shorter stretches hold no secret, encoded or not.
_READABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]{16,}")
_PADDING = re.compile("={0,2}")
_CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\s:%\\{}&#;]""")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans of one layer: leftmost and non-overlapping per kind, short ones dropped."""
    found = []
    for kind, pattern, least, group in PATTERNS:
        if kind == "hex":  # maximal runs, so short ones need not be visited
            found += [(kind, m.start(), m.end()) for m in _HEX_RUN.finditer(text)]
        else:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


class Layer:
    """A text and where it came from: starts[i], ends[i] bound what character i came
    from; without them it is part of the original from `at` on, or all of it came
    from the range `whole`."""

    __slots__ = ("text", "starts", "ends", "at", "whole")

    def __init__(self, text: str, starts=None, ends=None, at: int = 0, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.at, self.whole = text, starts, ends, at, whole

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return self.at + a, self.at + b
        return self.starts[a], self.ends[b - 1]

    def key(self) -> bytes:
        """Digest of the text and of where its characters came from."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for side in (self.starts, self.ends, array("q", self.whole or (self.at,))):
            h.update(b"/" + (side.tobytes() if side else b""))
        return h.digest()


def _pieces(chunks: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(offset, text) of pieces of about PIECE characters, cut only before characters
    that no pattern, escape or encoded run can hold: nothing that is looked for is cut."""
    held: list[str] = []
    at = size = 0
    for chunk in chunks:
        cut = -1
        if size + len(chunk) > PIECE:
            for m in _CUT.finditer(chunk):
                cut = m.start()
        if cut >= 0:
            text = "".join([*held, chunk[:cut]])
            yield at, text
            at += len(text)
            held, size, chunk = [], 0, chunk[cut:]
        held.append(chunk)
        size += len(chunk)
    yield at, "".join(held)


def _chunks(text: str) -> Iterator[str]:
    return (text[i : i + PIECE] for i in range(0, len(text), PIECE))


def _offsets(text: str) -> list[int]:
    """The byte offset of each character (plus the end) in UTF-8; lone surrogates stand
    for single bytes that are no UTF-8."""
    offsets, at = [], 0
    for ch in text:
        offsets.append(at)
        at += 1 if ch < "\x80" or "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8"))
    return [*offsets, at]


def _replaced(layer: Layer, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with each piece (start, end, [(character, start, end)]) put in place."""
    out, starts, ends, at = [], array("q"), array("q"), 0

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        if layer.whole:
            return
        if layer.starts is None:
            starts.extend(range(layer.at + a, layer.at + b))
            ends.extend(range(layer.at + a + 1, layer.at + b + 1))
        else:
            starts.extend(layer.starts[a:b])
            ends.extend(layer.ends[a:b])

    for a, b, chars in pieces:
        keep(at, a)
        for ch, i, j in chars:
            out.append(ch)
            if not layer.whole:
                i, j = layer.origin(i, j)
                starts.append(i)
                ends.append(j)
        at = b
    keep(at, len(layer.text))
    if layer.whole:
        return Layer("".join(out), whole=layer.whole)
    return Layer("".join(out), starts, ends)


def _unpercent(layer: Layer) -> Layer | None:
    pieces = []
    for m in _PERCENT.finditer(layer.text) if "%" in layer.text else ():
        text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        at = _offsets(text)
        pieces.append((m.start(), m.end(), [(ch, m.start() + 3 * at[i], m.start() + 3 * at[i + 1]) for i, ch in enumerate(text)]))
    return _replaced(layer, pieces) if pieces else None


def _unescape(layer: Layer) -> Layer | None:
    pieces = []
    if "\\" in layer.text or "&" in layer.text:
        for m in _ESCAPE.finditer(layer.text):
            if m[8]:
                char = html5.get(m[8], "")
                code = ord(char) if len(char) == 1 else 0
            else:
                code = int(m[6]) if m[6] else int(m[7], 8) if m[7] else int(next(g for g in m.groups() if g), 16)
            if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
                pieces.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
    return _replaced(layer, pieces) if pieces else None


def _inflate(parts: Iterable[bytes], rest: list[int]) -> Iterator[bytes]:
    """gzip, zlib or bzip2 content in chunks; zlib.error where it is broken or cut off.  The
    number of bytes after it is put into rest."""
    parts = iter(parts)
    first = next(parts, b"")
    parts = chain((first,), parts)
    if first[:3] == b"BZh":
        yield from _unbzip(parts, rest)
        return
    d = zlib.decompressobj(wbits=47)
    for part in parts:
        while part and not d.eof:
            yield d.decompress(part, PIECE)
            part = d.unconsumed_tail
        if d.eof:
            break
    while not d.eof:
        part = d.decompress(d.unconsumed_tail, PIECE)
        if not part and not d.eof:
            raise zlib.error("cut off")
        yield part
    rest[:] = [len(d.unused_data)]


def _unbzip(parts: Iterable[bytes], rest: list[int]) -> Iterator[bytes]:
    d = bz2.BZ2Decompressor()
    try:
        for part in parts:
            while not d.eof:
                yield d.decompress(part, PIECE)
                part = b""
                if d.needs_input:
                    break
            if d.eof:
                break
    except (OSError, ValueError) as broken:
        raise zlib.error(str(broken)) from None
    if not d.eof:
        raise zlib.error("cut off")
    rest[:] = [len(d.unused_data)]


def _packed(head: bytes) -> bool:
    return head[:3] == b"BZh" or head[:3] == b"\x1f\x8b\x08" or len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 < 8 and (head[0] * 256 + head[1]) % 31 == 0


def _inflated(raw: bytes) -> tuple[Iterator[str], int] | None:
    """The text of a compressed payload that starts raw, inflated as often as it was
    compressed, in chunks, and the payload's length; None if raw is no such payload.

    A layer of up to PIECE bytes, or twice those of raw, is held and inflated further from
    there; longer ones are inflated again from the last that was held.  One that was met before (a payload
    that inflates to itself) ends the chain."""
    held, depth, head, rest = raw, 0, raw[:3], [0]  # depth: layers from held on
    make = lambda n: _inflate(make(n - 1), rest if n == 1 else []) if n else iter((held,))
    used, seen, most = 0, set(), max(PIECE, 2 * len(raw))
    while _packed(head):
        try:
            head, size, kept, mark = b"", 0, [], hashlib.blake2b(digest_size=16)
            for part in make(depth + 1):  # to its end: a broken payload is none
                head += part[: 3 - len(head)]
                size += len(part)
                mark.update(part)
                kept = [*kept, part] if size <= most else []
        except zlib.error:
            break
        used = used or len(raw) - rest[0]
        if mark.digest() in seen:
            break
        seen.add(mark.digest())
        held, depth = (b"".join(kept), 0) if size <= most else (held, depth + 1)
    if not used:
        return None
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return (decoder.decode(part) for part in make(depth)), used


def _read(raw: bytes) -> Iterator[tuple[str, list[int] | range]]:
    """raw as text with the byte offset of each character: as UTF-8, and as UTF-16 of either
    order from either byte where many bytes are zero."""
    text = raw.decode("utf-8", "surrogateescape")
    if _READABLE.search(text):
        yield text, _offsets(text)
    if raw.count(0) >= 16:
        for swapped in (sys.byteorder == "big", sys.byteorder == "little"):
            for first in (0, 1):
                units = array("H", raw[first : first + (len(raw) - first) // 2 * 2])
                if swapped:
                    units.byteswap()
                text = "".join(map(chr, units))  # halves of pairs stay apart: two bytes a character
                if _READABLE.search(text):
                    yield text, range(first, first + 2 * len(units) + 1, 2)


def _from_base64(layer: Layer) -> Iterator[Layer]:
    """What the base64 runs of a layer hold, each run as it stands and joined over line
    breaks.  A token may start anywhere in a run (after a path or prefix, say), so
    all four alignments are decoded; the readable stretches and the compressed
    payloads in them are the layers."""
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            place = [m.start() + i for i, ch in enumerate(m[0]) if ch not in " \t\r\n="] if pattern is _WRAPPED else range(m.start(), m.end() - m[0].count("="))
            body = _BREAK.sub("", m[0]).rstrip("=").translate(_URL_SAFE)
            for shift in range(4) if len(body) >= 16 else ():
                part = body[shift:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                for at in [h.start() for h in _HEAD.finditer(raw) if h.start() % 3 == 0]:
                    if _packed(raw[at : at + 3]) and (got := _inflated(raw[at:])):
                        first, last = shift + at * 4 // 3, shift - (-(at + got[1]) * 4 // 3)
                        a, b = layer.origin(place[first], place[first] + 1)[0], layer.origin(place[last - 1], place[last - 1] + 1)[1]
                        whole = (a, layer.origin(m.start(), m.end())[1] if last >= len(body) else b)
                        for _, text in _pieces(got[0]):
                            yield Layer(text, whole=whole)
                for text, bounds in _read(raw):
                    for r in _READABLE.finditer(text):
                        if layer.whole:
                            yield Layer(r[0], whole=layer.whole)
                            continue
                        starts, ends = array("q"), array("q")
                        for i in range(r.start(), r.end()):
                            a, b = shift + bounds[i] * 4 // 3, min(shift - (-bounds[i + 1] * 4 // 3), len(body)) - 1
                            starts.append(layer.origin(place[a], place[a] + 1)[0])
                            ends.append(layer.origin(place[b], place[b] + 1)[1])
                        yield Layer(r[0], starts, ends)


def _opened(layer: Layer) -> Iterator[Layer]:
    yield from (x for x in (_unpercent(layer), _unescape(layer)) if x)
    yield from _from_base64(layer)


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans (base ones and those of the decoded layers), in order."""
    order = lambda s: (s[1], KINDS[s[0]], s[2])
    if not text:
        return [], []
    base = sorted(scan(text), key=order)
    spans, seen = set(base), set()
    work = [(Layer(piece, at=at) for at, piece in _pieces(_chunks(text)))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        key = new.key()
        if key in seen:
            continue
        seen.add(key)
        if len(work) > 1:
            spans.update((kind, *new.origin(a, b)) for kind, a, b in scan(new.text))
        work.append(_opened(new))
    return base, sorted(spans, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, base and all spans as arrays of
    (kind, start, end), in code points, end exclusive.  No shuffle."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("base", span), ("spans", span)])

    def run(batches):
        for batch in batches:
            got = [find_secrets(t) for t in batch.column(1).to_pylist()]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_rows(b) for b, _ in got], span), pa.array([as_rows(s) for _, s in got], span)], schema=schema
            )

    spans_type = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id bigint, base {spans_type}, spans {spans_type}").withColumnRenamed("id", id_col)


def redact_text(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every secret span replaced by mark; overlapping spans become one."""
    base, spans = find_secrets(text)
    if not spans:
        return text
    merged: list[list[int]] = []
    for kind, a, b in spans:
        if (kind, a, b) not in base:  # what is left of an encoded run's padding goes with it
            b += len(_PADDING.match(text, b)[0])
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced; other columns and rows as they were."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            cols[at] = pa.array([redact_text(t) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
