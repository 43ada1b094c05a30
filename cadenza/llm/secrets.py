"""Secret scanning with a recursive decoding worklist.

Every layer of a text is scanned with the same three patterns.  From each layer, encoded stretches are unwrapped into
new layers: percent escapes and Unicode or hex escapes (rewritten in place, so the layer keeps its surroundings),
base64, also over several lines and at all four alignments, and compressed streams in it (a layer of their own each).  A layer that was seen before, with the same text from
the same places, is not entered again, so the worklist ends at a fixpoint; equal texts from other places are.  Each layer carries, for each of its characters, the stretch of the original text that
it came from; a finding in any layer is reported at the original stretch.

Defined cases: null text counts as empty; an empty text has no findings; equal findings of several layers count once;
repeated rows give repeated results; an empty table gives an empty result; only the id and text columns are read.
Compressed layers are inflated up to ``MAX_INFLATED`` bytes, a guard against decompression bombs (nothing else is
bounded by size); what lies beyond is counted in ``n_cut``, so a text that was not scanned to its end can be told.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_INFLATED = 1 << 26

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Base64 over several lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Where gzip, zstd and zlib streams begin.
_MAGIC = re.compile(rb"(?=\x1f\x8b\x08|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff])")

Finding = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Finding]:
    """Base findings of one layer: leftmost, non-overlapping for each kind; too short ones are dropped afterwards."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text and the original stretch of each of its characters (None: the text is the original)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """Original stretch of characters a to b - 1."""
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def key(self) -> tuple[str, bytes]:
        """The text and a digest of the places it came from."""
        return self.text, hashlib.blake2b(b"" if self.start is None else self.start.tobytes() + self.end.tobytes(), digest_size=16).digest()


def _rewritten(layer: Layer, parts: list[tuple[int, int, str, list[int] | None]]) -> Layer:
    """``layer`` with stretches replaced: (from, to, new text, width in the old text of each new character or None)."""
    text, starts, ends, out, at = layer.text, [], [], [], 0
    own_s = layer.start if layer.start is not None else np.arange(len(text))
    own_e = layer.end if layer.end is not None else np.arange(1, len(text) + 1)
    for a, b, new, widths in parts:
        out += [text[at:a], new]
        starts.append(own_s[at:a])
        ends.append(own_e[at:a])
        if widths is None:
            starts.append(np.full(len(new), own_s[a:b].min()))
            ends.append(np.full(len(new), own_e[a:b].max()))
        else:
            stop = a + np.cumsum(widths)
            starts.append(own_s[stop - np.array(widths)])
            ends.append(own_e[stop - 1])
        at = b
    out.append(text[at:])
    starts.append(own_s[at:])
    ends.append(own_e[at:])
    return Layer("".join(out), np.concatenate(starts), np.concatenate(ends))


def _unquoted(layer: Layer) -> Layer | None:
    """Percent escapes read as UTF-8 where they are, as Latin-1 elsewhere."""
    parts = []
    for m in _URL.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = raw.decode("utf-8")
        except UnicodeDecodeError:
            new = raw.decode("latin-1")
            widths = [3] * len(new)
        else:
            widths = [3 * len(c.encode("utf-8")) for c in new]
        parts.append((m.start(), m.end(), new, widths))
    return _rewritten(layer, parts) if parts else None


def _unescaped(layer: Layer) -> Layer | None:
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        k = m.lastindex
        code = int(m[k], 10 if k == 6 else 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            parts.append((m.start(), m.end(), chr(code), [m.end() - m.start()]))
    return _rewritten(layer, parts) if parts else None


def _inflated(raw: bytes, start: int) -> tuple[bytes, int | None, bool] | None:
    """Content of the gzip, zlib or zstd stream at ``start``, with the gzip members that follow it: what can be read of
    it, where it ends (None: it is damaged or cut off) and whether the guard cut it.  None if nothing can be read.
    """
    if raw[start : start + 4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        out, end, size = [], None, 0
        try:
            with zstandard.ZstdDecompressor().stream_reader(raw[start:], read_across_frames=True) as reader:
                while size < MAX_INFLATED and (got := reader.read(min(1 << 16, MAX_INFLATED - size))):
                    out.append(got)
                    size += len(got)
                return b"".join(out), len(raw), size >= MAX_INFLATED and bool(reader.read(1))
        except zstandard.ZstdError:  # what came before the damage counts
            pass
        return (b"".join(out), end, False) if out else None
    out, size, at = [], 0, start
    while True:
        unpack = zlib.decompressobj(47)
        try:
            # In small steps: what came before a damage counts.
            for k in range(at, len(raw), 4096):
                got = unpack.decompress(raw[k : k + 4096], MAX_INFLATED - size + 1)
                out.append(got[: MAX_INFLATED - size])
                size += len(got)
                if size > MAX_INFLATED:
                    return b"".join(out), None, True
                if unpack.eof:
                    break
        except zlib.error:
            break
        if not unpack.eof:
            break
        at = min(k + 4096, len(raw)) - len(unpack.unused_data)
        more = raw[at:].lstrip(b"\0")
        if not more.startswith(b"\x1f\x8b\x08"):
            return b"".join(out), at, False
        at = len(raw) - len(more)
    return (b"".join(out), None, False) if size else None


def _begins(raw: bytes, at: int) -> bool:
    """Whether a header is at ``at``; that of zlib is checked by its remainder."""
    return raw[at] in b"\x1f\x28" and raw[at + 1] in b"\x8b\xb5" or (raw[at] << 8 | raw[at + 1]) % 31 == 0 and not raw[at + 1] & 0x20


def _streams(raw: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(start, content, cut) of the compressed streams anywhere in ``raw``."""
    done = 0
    for m in _MAGIC.finditer(raw):
        if m.start() >= done and _begins(raw, m.start()) and (found := _inflated(raw, m.start())):
            content, end, cut = found
            done = end or done  # only a stream that is whole proves that what lies in it is no stream of its own
            yield m.start(), content, cut


def _idle(text: str) -> bool:
    """Whether a layer holds neither findings nor anything to unwrap."""
    return not (scan(text) or _URL.search(text) or _ESCAPE.search(text) or _BASE64.search(text))


def _stretches(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 stretches, without line breaks: characters, their places, and the end including the padding."""
    for m in _BASE64.finditer(text):
        yield m[0].rstrip("="), np.arange(m.start(), m.end()), m.end()
    for m in _WRAPPED.finditer(text):
        body = "".join(m[0].rstrip("=").split())
        if len(body) >= 16:
            places = [np.arange(p.start(), p.end()) + m.start() for p in _LINE.finditer(m[0])]
            yield body, np.concatenate(places), m.end()


def _payloads(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    """Layers from base64 stretches, and of the compressed streams in them, and whether the guard cut a stream.

    A payload may begin anywhere in a stretch, so all four alignments are decoded.  All that is sought is ASCII, so
    bytes are read as Latin-1, whatever they are.  Layers that hold nothing are left out.
    """
    own_s = layer.start if layer.start is not None else np.arange(len(layer.text))
    own_e = layer.end if layer.end is not None else np.arange(1, len(layer.text) + 1)
    for stretch, places, stop in _stretches(layer.text):
        stretch = stretch.translate({45: 43, 95: 47})
        for shift in range(min(4, len(stretch))):
            body = stretch[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            new = raw.decode("latin-1")
            if not _idle(new):  # each byte comes from two of the encoded characters
                at = np.arange(len(new)) * 8
                yield Layer(new, own_s[places[shift + at // 6]], own_e[places[shift + (at + 7) // 6]]), False
            work, met = [(None, raw)], {hashlib.sha256(raw).digest()}
            while work:
                place, outer = work.pop()
                for start, content, cut in _streams(outer):
                    first = places[shift + start * 8 // 6] if place is None else place
                    digest = hashlib.sha256(content).digest()
                    fresh = digest not in met
                    met.add(digest)
                    if fresh:
                        work.append((first, content))
                    new = content.decode("latin-1")
                    found = None if _idle(new) else Layer(new, np.full(len(new), own_s[first : stop].min()), np.full(len(new), own_e[first : stop].max()))
                    if found or cut:
                        yield found, cut


def find(text: str) -> tuple[list[Finding], list[Finding], int]:
    """Base findings, all findings (base ones included, each once) and the number of layers that the guard cut."""
    base = sorted(scan(text))
    every = set(base)
    work = [Layer(text)]
    seen = {work[0].key()}
    n_cut = 0
    while work:
        layer = work.pop()
        fresh = [(x, False) for x in (_unquoted(layer) if "%" in layer.text else None, _unescaped(layer) if "\\" in layer.text or "&#" in layer.text else None) if x is not None]
        for new, cut in [*fresh, *_payloads(layer)]:
            n_cut += cut
            if new is None:
                continue
            if (key := new.key()) in seen:
                continue
            seen.add(key)
            work.append(new)
            for a, kind, b in scan(new.text):
                start, end = new.origin(a, b)
                every.add((start, kind, end))
    return base, sorted(every), n_cut


def listed(found: list[Finding]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: n_assign, n_access, n_hex (base), base and all spans as text, n_layers_cut."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(f[1] == k for f in base) for base, _, _ in rows], pa.int64()) for k in range(3)]
            strings = [pa.array([listed(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, strings[0], pa.array([hashlib.sha256(listed(r[0]).encode()).hexdigest() for r in rows], pa.string()), strings[1], pa.array([r[2] for r in rows], pa.int64())],
                names=["id", "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans", "n_cut"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, base_sha256 string, spans string, n_cut bigint"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
