"""Secrets in texts and in whatever the texts carry encoded.

A worklist begins with the text itself. Each layer is scanned by the patterns of the three kinds, and every encoded part of it becomes
a layer of its own: runs with percent, \\u, \\x or &#; escapes, decoded in place with what stands around them; base64 tokens, plain or
url-safe, at each of the four places where their groups may begin; and gzip, zlib, bzip2 or xz streams, unpacked piece by piece. It ends
when no layer gives a new one. A layer that covers the same stretch of the text with the same content as one before is not entered
again, so streams that unpack to themselves end.

Every character of a layer knows the stretch of the text that it comes from, so a match anywhere is a span of the text: the escapes or
base64 digits that spell it, or the whole of a compressed stream. Layers below the text are read byte for byte as Latin-1, since all
patterns and encodings are ASCII."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common

# What counts as a secret, by kind, and how long it must be.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = (6, 20, 24)

_ASSIGN, _ACCESS = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS)
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: One escape. Any number of backslashes, and of 25 after a percent sign, is one escape that was escaped again.
_ESCAPE = re.compile(r"%(?:25)*(?P<url>[0-9A-Fa-f]{2})|\\+u(?P<u>[0-9A-Fa-f]{4})|\\+x(?P<x>[0-9A-Fa-f]{2})|&#(?P<dec>[0-9]{1,7});|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});")
#: What patterns and encodings are made of: nothing that they match reaches beyond such a run.
_RUN = re.compile(r"""[A-Za-z0-9+/_.=\-"' :%\\&#;\r\n]+""")
_BETWEEN = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\&#;\r\n]""")
#: The shortest base64 that can hold a secret has 16 digits (token=abcdef). Full lines may be broken, as in mail.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{76})\r?\n)*[A-Za-z0-9+/_-]{16,}")
_STREAM = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]", re.DOTALL)
#: A text or layer without a match of this holds no secret and nothing encoded.
CANDIDATE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#[0-9xX]"
_CANDIDATE = re.compile(CANDIDATE)

#: Characters of a compressed stream that are unpacked at a time; a piece ends between runs, unless one run alone is longer than RUN.
PIECE, RUN = 1 << 20, 1 << 22


class Layer(NamedTuple):
    """A text, and for each character the stretch [start, end) of the document's text that it comes from."""

    text: str
    start: np.ndarray
    end: np.ndarray
    root: bool = False

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return self.start[lo:hi], self.end[lo:hi]


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost matches that do not overlap, by kind; those that are too short are dropped."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST[0]:
            yield m.start(), 0, m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST[1]:
            yield m.start(), 1, m.end()
    for m in _HEX.finditer(text):  # the same as runs of any length of which the short ones are dropped
        yield m.start(), 2, m.end()


def _unescaped(layer: Layer) -> Iterator[Layer]:
    """Each run of the layer that holds an escape, with its escapes decoded."""
    if not _ESCAPE.search(layer.text):
        return
    for run in _RUN.finditer(layer.text):
        found = list(_ESCAPE.finditer(layer.text, run.start(), run.end()))
        if not found:
            continue
        text, starts, ends, at = [], [], [], run.start()
        for m in found:
            code = int(m[m.lastgroup], 10 if m.lastgroup == "dec" else 16)
            s, e = layer.part(at, m.start())
            text += [layer.text[at : m.start()], chr(code) if code < 0x110000 else "�"]
            starts += [s, layer.start[m.start() : m.start() + 1]]
            ends += [e, layer.end[m.end() - 1 : m.end()]]
            at = m.end()
        s, e = layer.part(at, run.end())
        yield Layer("".join([*text, layer.text[at : run.end()]]), np.concatenate([*starts, s]), np.concatenate([*ends, e]))


def _debased(layer: Layer) -> Iterator[Layer]:
    """The bytes of each base64 token, for each of the four places at which groups of digits may begin."""
    for m in _BASE64.finditer(layer.text):
        digits = np.arange(m.start(), m.end())
        token = m[0]
        if "\n" in token:
            digits = digits[[c not in "\r\n" for c in token]]
            token = token.replace("\r", "").replace("\n", "")
        token = token.translate({45: "+", 95: "/"})
        for phase in range(4):
            own = token[phase:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            raw = binascii.a2b_base64(own + "=" * (-len(own) % 4))
            text = raw.decode("latin-1")
            if _CANDIDATE.search(text) or _STREAM.search(text):
                byte = np.arange(len(raw))
                first, last = digits[phase + byte * 4 // 3], digits[phase + (byte * 4 + 6) // 3 - 1]
                yield Layer(text, layer.start[first], layer.end[last])


def _unpacker(data: bytes):
    """A decompressor for a stream by its first bytes."""
    if data[0] == 0x1F:
        return zlib.decompressobj(31)
    return bz2.BZ2Decompressor() if data[0] == 0x42 else lzma.LZMADecompressor() if data[0] == 0xFD else zlib.decompressobj()


def unpacked(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of data are left) of the stream that data begins with, a piece at a time. A broken stream gives what comes before the break."""
    obj = _unpacker(data)
    more = data
    while True:
        try:
            out = obj.decompress(more, PIECE)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        done = obj.eof
        more = b"" if not hasattr(obj, "unconsumed_tail") else obj.unconsumed_tail
        if out or done:
            yield out, len(obj.unused_data)
        if done or not out:
            return


def _pieces(chunks: Iterator[tuple[bytes, int]], left: list[int]) -> Iterator[str]:
    """The chunks as texts that begin and end between runs, so that no match is cut. left[0] becomes what the stream did not use."""
    held, size = [], 0
    for raw, left[0] in chunks:
        chunk = raw.decode("latin-1")
        last = _BETWEEN.search(chunk[::-1])
        cut = len(chunk) - last.start() if last else len(chunk) if size + len(chunk) > RUN else 0
        held.append(chunk[: cut or None])
        size += len(held[-1])
        if cut:
            yield "".join(held)
            held, size = [chunk[cut:]], len(chunk) - cut
    if size:
        yield "".join(held)


def _inflated(layer: Layer) -> Iterator[Layer]:
    """What the compressed streams of a layer hold: all of it comes from the whole stream."""
    at = 0
    while m := _STREAM.search(layer.text, at):
        data, left = layer.text[m.start() :].encode("latin-1", "replace"), [0]
        at = m.start() + 1
        for text in _pieces(unpacked(data), left):
            end = len(layer.text) - left[0]
            whole = np.full(1, layer.start[m.start()]), np.full(1, layer.end[end - 1])
            yield Layer(text, *(np.broadcast_to(x, len(text)) for x in whole))
            at = max(at, end)


def _below(layer: Layer) -> Iterator[Layer]:
    yield from _unescaped(layer)
    yield from _debased(layer)
    if not layer.root:
        yield from _inflated(layer)


def hidden(text: str, below: Callable[[Layer], Iterator[Layer]] = _below) -> set[tuple[int, int, int]]:
    """(start, kind, end) of the matches of every layer below the text, as spans of the text.

    The worklist is a stack of layers' children, which are made one at a time: what is held at once is one layer for each level."""
    todo = [below(Layer(text, at := np.arange(len(text)), at + 1, True))]
    seen, out = set(), set()
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if not len(layer.text):
            continue
        name = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.start[0]), int(layer.end[-1])
        if name in seen:
            continue
        seen.add(name)
        out.update((int(layer.start[s]), kind, int(layer.end[e - 1])) for s, kind, e in matches(layer.text))
        todo.append(below(layer))
    return out


def added(base: list[tuple[int, int, int]], found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the spans found, those that lie in no other span of their kind, be it found as well or one of the base."""
    out = []
    for kind in range(len(KINDS)):
        spans = sorted([(s, -e, 0) for s, k, e in base if k == kind] + [(s, -e, 1) for s, k, e in found if k == kind])
        reach = -1
        for s, e, new in spans:
            if new and -e > reach:
                out.append((s, kind, -e))
            reach = max(reach, -e)
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")


def _scan(batches):
    for batch in batches:
        ids, col = batch.column("doc_id"), common.text_column(batch)
        some = pc.match_substring_regex(col, CANDIDATE).to_numpy(zero_copy_only=False)
        for lo in range(0, len(col), 1024):
            rows = []
            for k in range(lo, min(lo + 1024, len(col))):
                base, new = [], []
                if some[k]:
                    text = col[k].as_py()
                    base = sorted(matches(text))
                    new = added(base, hidden(text))
                name = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(sum(s[1] == kind for s in base) for kind in range(len(KINDS))), name, _joined(sorted(base + new)), len(new)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2 + [pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(rows)), *cols], list(_OUT))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) for each row of docs(doc_id, text).

    Counts and base_sha256 are of the patterns' matches in the text itself; spans has these and the n_added ones of the layers below
    it, as kind:start:end in code points. Null, empty and clean texts have no spans: counts 0, the hash of the empty text, and ''.
    Texts are read whole, however long; of a compressed stream PIECE characters are held at a time, or one run of up to RUN of them.
    Rows that repeat are answered alike, other columns are not read, whatever their names, and an empty table gives no rows."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
