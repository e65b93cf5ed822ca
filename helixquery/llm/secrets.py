"""Secret scans with a recursive decoding worklist.

A text is the first layer. Every layer is scanned for secrets and unwrapped: URL escapes, Unicode
escapes, base64 runs (over wrapped lines, from each of the four places where a group of four letters may begin, so that what
stands in front of or behind an encoded secret doesn't hide it), and compressed bytes anywhere inside base64. Each result is a layer of its own that waits
in the worklist unless a layer with the same content from the same places of the text was seen (cycles
end there, equal content from other places does not); the work ends when nothing new comes up. Every layer knows for each of its characters which characters of the text it came
from, so that findings of any depth are spans of the text.

Defined results: null or empty texts have no spans; the same span found in several layers counts once.
A compressed run is unpacked to its end, over all members, in pieces of about PIECE bytes that are cut where no
pattern can match across, so memory is bounded by PIECE and the longest stretch without such a place, and time is
not bounded: a bomb is scanned whole. A broken stream is scanned as far as it goes. Bytes that aren't UTF-8 stand as U+FFFD in a URL
escape; of decoded base64 and of unpacked bytes the UTF-8 stretches of SHORTEST characters or more are layers. A text is unwrapped in pieces between
characters that no encoding has, so what a layer knows of its places is as long as its piece.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import text

KINDS = ["assign", "access", "hex"]
PIECE = 1 << 20

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: A run, over the ends of lines that are all of it.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)*[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")
#: Letters of the shortest secret.
SHORTEST = 12
#: One character of UTF-8.
_UTF8 = rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
STRETCH = re.compile(rb"(?:" + _UTF8 + rb"){%d,}" % SHORTEST)
ONE = re.compile(rb"(?:" + _UTF8 + rb")|[\x80-\xff]")
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
#: Stretches of a text that are unwrapped by themselves.
TOGETHER = re.compile(r"""[A-Za-z0-9+/_.=\-"'\x20:%\\&#;\t\r\n]+""")
#: Texts without any of these have neither secrets nor layers.
WORTH_A_LOOK = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24}|%[0-9a-f]{2}|\\[ux][0-9a-f]{2}|&#|[a-z0-9+/_-]{16}"
#: Characters outside all patterns: a text may be cut behind one, no match of any layer reaches over it.
BREAK = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:%\\&#;]""")

Layer = tuple[str, np.ndarray, np.ndarray]


def base_spans(s: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in s itself."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(s)]
    return sorted(found)


def _url(m: re.Match) -> tuple[str, list[int], list[int]]:
    out, starts, ends = [], [], []
    raw, a = binascii.unhexlify(m[0].replace("%", "")), m.start()
    for c in ONE.finditer(raw):
        out.append(c[0].decode(errors="replace"))
        starts.append(a + 3 * c.start())
        ends.append(a + 3 * c.end())
    return "".join(out), starts, ends


def _unicode(m: re.Match) -> tuple[str, list[int], list[int]] | None:
    s, a = m[0], m.start()
    if s[0] == "&":
        number = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        return (chr(number), [a], [m.end()]) if number <= 0x10FFFF and not 0xD800 <= number < 0xE000 else None
    if s[1] == "x":
        return chr(int(s[2:], 16)), [a], [m.end()]
    if s[1] == "U":
        number = int(s[2:], 16)
        return (chr(number), [a], [m.end()]) if number <= 0x10FFFF and not 0xD800 <= number < 0xE000 else None
    units = [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)]
    out, starts, ends, i = [], [], [], 0
    while i < len(units):
        n = 2 if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000 else 1
        code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if n == 2 else units[i]
        out.append(chr(code) if not 0xD800 <= code < 0xE000 else "�")
        starts.append(a + 6 * i)
        ends.append(a + 6 * (i + n))
        i += n
    return "".join(out), starts, ends


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with all matches decoded; None if there are none."""
    s, starts, ends = layer
    parts, first, last, at = [], [], [], 0
    for m in pattern.finditer(s):
        got = decode(m)
        if got is None:
            continue
        parts += [s[at : m.start()], got[0]]
        first += [starts[at : m.start()], starts[got[1]]]
        last += [ends[at : m.start()], ends[np.array(got[2]) - 1]]
        at = m.end()
    if not parts:
        return None
    return "".join([*parts, s[at:]]), np.concatenate([*first, starts[at:]]), np.concatenate([*last, ends[at:]])


class _Source:
    """Pieces of bytes as a file for one reader at a time; what a reader leaves can be given back."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, b""

    def read(self, n: int) -> bytes:
        while not self.left:
            try:
                self.left = next(self.pieces)
            except StopIteration:
                return b""
        out, self.left = self.left[:n], self.left[n:]
        return out

    def head(self, n: int) -> bytes:
        while len(self.left) < n:
            try:
                self.left += next(self.pieces)
            except StopIteration:
                break
        return self.left[:n]


def _member(source: _Source) -> Iterator[bytes]:
    """One member of a zlib, gzip or bzip2 stream; its rest goes back to the source."""
    bzip = source.head(3) == b"BZh"
    d = bz2.BZ2Decompressor() if bzip else zlib.decompressobj(47)
    while not d.eof:
        data = source.read(1 << 16)
        if not data:
            return
        while True:
            out = d.decompress(data, PIECE)
            data = b"" if bzip else d.unconsumed_tail
            if out:
                yield out
            if d.eof or (d.needs_input if bzip else not data and len(out) < PIECE):
                break
    source.left = d.unused_data + source.left


def unpacked(pieces: Iterator[bytes], rest: list[int] | None = None) -> Iterator[bytes]:
    """What compressed bytes hold, by the first bytes of each member, as far as it can be read; nothing if they aren't compressed.
    rest: gets the number of bytes behind the last member that were read."""
    source = _Source(pieces)
    try:
        while True:
            head = source.head(4)
            if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or (head[:1] == b"\x78" and head[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda")):
                yield from _member(source)
            elif head == b"\x28\xb5\x2f\xfd":
                import zstandard

                reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(source, read_across_frames=True)
                while out := reader.read(PIECE):
                    yield out
                if rest is not None:
                    rest.append(len(source.left))
                return
            else:
                if rest is not None:
                    rest.append(len(source.left))
                return
    except (zlib.error, OSError, ValueError, EOFError):  # a broken stream ends here
        return
    except Exception as error:
        if type(error).__name__ != "ZstdError":
            raise


def _digest(pieces: Iterator[bytes]) -> tuple[bytes, bytes | None]:
    """The digest of bytes, and themselves if they are few."""
    h, few, size = hashlib.sha256(), [], 0
    for x in pieces:
        h.update(x)
        size += len(x)
        few = [*few, x] if size <= 4 * PIECE else []
    return h.digest(), b"".join(few) if size <= 4 * PIECE else None


def _text_pieces(pieces: Iterator[bytes]) -> Iterator[str]:
    """The UTF-8 in bytes (U+FFFD for the rest) as strings of about PIECE bytes, cut behind characters that no pattern has."""
    decoder, held, size = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for x in pieces:
        new = decoder.decode(x)
        size += len(new)
        cut = 0
        if size >= PIECE:
            back = BREAK.search(new[::-1])
            cut = len(new) - back.start() if back else 0
        if cut:
            yield "".join([*held, new[:cut]])
            held, size = [new[cut:]], len(new) - cut
        else:
            held.append(new)
    if size:
        yield "".join(held)


def unpacked_texts(raw: bytes, start: int = 0, end: list[int] | None = None) -> Iterator[str]:
    """The text of all levels of compression in raw from a place on (not raw itself), in pieces. end: gets where it ends."""
    rest: list[int] = []
    read = start

    def chunks() -> Iterator[bytes]:
        nonlocal read
        for i in range(start, len(raw), 1 << 16):
            read = min(len(raw), i + (1 << 16))
            yield raw[i : i + (1 << 16)]

    chain: Callable[[], Iterator[bytes]] = chunks
    seen = {hashlib.sha256().digest()}
    while True:
        inner = lambda outer=chain: unpacked(outer(), rest)
        digest, few = _digest(inner())
        if end is not None and not end:
            end.append(read - rest[0] if rest else start + 1)
        if digest in seen:
            return
        seen.add(digest)
        chain = inner if few is None else lambda few=few: iter([few])
        yield from _text_pieces(chain())


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    s, starts, ends = layer
    for m in BASE64.finditer(s):
        run, at = m[0], np.arange(m.start(), m.end(), dtype=np.int32)
        breaks = list(LINE_END.finditer(run))
        if breaks:
            keep = np.ones(len(run), dtype=bool)
            for x in breaks:
                keep[x.start() : x.end()] = False
            run, at = LINE_END.sub("", run), at[keep]
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            part = run[shift : shift + (len(run) - shift) // 4 * 4] if (len(run) - shift) % 4 == 1 else run[shift:]
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            done, taken = 0, []
            for packed in PACKED.finditer(raw):
                if packed.start() < done:  # a member of what was unpacked
                    continue
                first, end = shift + 4 * (packed.start() // 3), []
                for inner in unpacked_texts(raw, packed.start(), end):
                    done = end[0]
                    yield inner, np.full(len(inner), starts[at[first]]), np.full(len(inner), ends[at[-1]])
                if done > packed.start():
                    taken.append((packed.start(), done))
            for x in STRETCH.finditer(raw):
                if any(a <= x.start() and x.end() <= b for a, b in taken):  # bytes of a compressed stream are no text
                    continue
                text_ = x[0].decode()
                sizes = np.array([len(c.encode()) for c in text_]) if len(text_) < len(x[0]) else np.ones(len(text_), dtype=np.int64)
                until = x.start() + np.cumsum(sizes)
                a, b = until - sizes, until - 1  # first and last byte of each character
                low = shift + 4 * (a // 3) + a % 3
                high = np.minimum(shift + 4 * (b // 3) + b % 3 + 1, len(run) - 1)
                yield text_, starts[at[low]], ends[at[high]]


def _layers(layer: Layer) -> Iterator[Layer]:
    """What is encoded in a layer, one at a time."""
    for x in (_replaced(layer, URL_ESCAPE, _url), _replaced(layer, UNICODE_ESCAPE, _unicode)):
        if x is not None:
            yield x
    yield from _base64_layers(layer)


def _identity(layer: Layer) -> bytes:
    """A digest of a layer's content and of the places that its characters came from."""
    h = hashlib.sha256(layer[0].encode("utf-8", "surrogatepass"))
    h.update(layer[1].astype(np.int64).tobytes())
    h.update(layer[2].astype(np.int64).tobytes())
    return h.digest()


def all_spans(s: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in s and in what is encoded in it."""
    found = set(base_spans(s))
    for m in TOGETHER.finditer(s):
        own = m[0]
        if not (URL_ESCAPE.search(own) or UNICODE_ESCAPE.search(own) or BASE64.search(own)):
            continue
        places = np.arange(m.start(), m.end() + 1, dtype=np.int64 if len(s) >= 1 << 31 else np.int32)
        whole: Layer = (own, places[:-1], places[1:])
        work, seen = [_layers(whole)], {_identity(whole)}
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
            elif layer[0] and (same := _identity(layer)) not in seen:
                seen.add(same)
                for a, kind, b in base_spans(layer[0]):
                    found.add((int(layer[1][a:b].min()), kind, int(layer[2][a:b].max())))
                work.append(_layers(layer))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FIELDS = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _row(s: str) -> tuple:
    base = base_spans(s)
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(s))


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in FIELDS]))
def secrets(texts: pa.Array) -> pa.Array:
    """Counts of base secrets, a digest of their spans, and all spans."""
    rows = [NOTHING] * len(texts)
    for a, b in text.steps(texts):
        some = pc.fill_null(texts.slice(a, b - a), "")
        for i in np.flatnonzero(pc.match_substring_regex(some, WORTH_A_LOOK).to_numpy(zero_copy_only=False)).tolist():
            rows[a + i] = _row(some[i].as_py())
    types = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [n for n, _ in FIELDS])
