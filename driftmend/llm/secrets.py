"""Secret scan with structural confirmation.

Three plain patterns find assigned secrets, access-key ids and hex keys. Beyond them, long runs of base64
or hex characters are decoded and reported only if what comes out is built as a key or token is: DER whose
nested lengths add up and which begins like a private key, the length-prefixed private-key format of
OpenSSH, PEM blocks around either, and signed tokens whose header is JSON that names an algorithm. They are
found at any place of a run, as after the / of a path; a key's own lengths say where it ends.

Positions are code points, ends exclusive. A text is scanned as one byte per code point (characters
beyond Latin-1 stand as '?', which no pattern accepts), so that positions need no mapping.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "openssh", "pem")
SPANS = "array<struct<kind:string,start:long,end:long>>"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MARK = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_MIN_HEX, _MIN_RUN = 24, 16

# A SEQUENCE, its length in each form, then a version 0 to 3, as base64 and as hex
_C = rb"[A-Za-z0-9+/_-]"
_DER64 = re.compile(rb"M(?:[B-H]_CAQ[AEIM]|I(?:[E-H]_AgE[A-D]|[I-L]__[AQgw]IBA|[M-P]____CAQ[AEIM]|[Q-T]_____AgE[A-D]))".replace(b"_", _C))
_DER16 = re.compile(rb"30(?:[1-7]_|81__|82____|83______|84________)02010[0-3]".replace(b"_", b"[0-9a-fA-F]"))
_HEX_RUN = re.compile(rb"[0-9a-fA-F]{48,}")
_OUTER64, _OUTER16 = re.compile(rb"(?=M[B-I])"), re.compile(rb"(?=30)")
_SSH64 = re.compile(rb"b3BlbnNzaC1rZXktdjEA")
_SSH16 = re.compile(b"openssh-key-v1\0".hex().encode(), re.IGNORECASE)
_ESCAPES = [(re.compile(rb"(?<!\\)\\+(?:[nrt]|u000[aAdD])"), b"\n"), (re.compile(rb"(?<!\\)\\+u003[dD]"), b"="), (re.compile(rb"(?<!\\)\\+u002[bB]"), b"+"), (re.compile(rb"(?<!\\)\\+(?:/|u002[fF])"), b"/")]
_HEADER = re.compile(rb"(?<![A-Za-z0-9-])[A-Za-z][A-Za-z0-9-]*:[^\S\n]*\S*")
# Of a token's header: its first key, what counts for its brackets, and what may follow it
DEEPEST = 32
_KEY, _PART, _BLANK = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"\s*:', re.DOTALL), re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.DOTALL), re.compile(r"[ \t\n\r]*\Z")
_ENCRYPTED = re.compile(rb"Proc-Type:\s*4,ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}")


def _classes(chars: bytes) -> bytes:
    return bytes(ord("x") if c in chars else ord(" ") for c in range(256))


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_HEX = _classes(_DIGITS + b"abcdef")
_ANY_HEX = _DIGITS + b"abcdefABCDEF"
_BASE64 = _classes(_LETTERS + _DIGITS + b"+/_-")
_URL = _classes(_LETTERS + _DIGITS + b"_-")


def _runs(text: bytes, table: bytes, least: int) -> Iterator[tuple[int, int]]:
    """The maximal runs of the table's characters with so many of them or more."""
    marked = text.translate(table)
    need, at = b"x" * least, 0
    while (start := marked.find(need, at)) >= 0:
        end = marked.find(b" ", start)
        at = len(marked) if end < 0 else end
        yield start, at


def _elements(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the DER elements that fill a part of data exactly, with every nested length checked; else None."""
    found, end = [], len(data) if end is None else end
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            size, at = int.from_bytes(data[at : at + more]), at + more
        if at + size > end:
            return None
        if tag & 0x20 and (depth > 8 or _elements(data, at, at + size, depth + 1) is None):
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_private_der(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """One SEQUENCE that begins with a version 0 to 3, then a number, algorithm or key string."""
    end = len(data) if end is None else end
    if end - at < 24 or data[at] != 0x30:
        return False
    outer = _elements(data, at, end)
    if outer is None or len(outer) != 1:
        return False
    inner = _elements(data, *outer[0][1:])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or data[inner[0][1] : inner[0][2]] not in (b"\0", b"\1", b"\2", b"\3"):
        return False
    return inner[1][0] in (0x02, 0x30, 0x04) and inner[1][2] - inner[1][1] >= 3


def is_encrypted_der(data: bytes) -> bool:
    """One SEQUENCE of an algorithm, which begins with its identifier, and the encrypted key."""
    outer = _elements(data) if data[:1] == b"\x30" else None
    inner = _elements(data, *outer[0][1:]) if outer and len(outer) == 1 else None
    if not inner or [tag for tag, *_ in inner] != [0x30, 0x04] or inner[1][2] - inner[1][1] < 16:
        return False
    algorithm = _elements(data, *inner[0][1:])
    return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][2] - algorithm[0][1] >= 3


def _openssh_size(data: bytes, begin: int = 0) -> int | None:
    """Bytes of the magic, cipher, key derivation and options, the number of keys, and that many keys and a private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, begin):
        return None
    at, strings, count = begin + len(magic), 0, None
    while count is None or strings < 3 + count + 1:
        if at + 4 > len(data):
            return None
        size, at = int.from_bytes(data[at : at + 4]), at + 4
        if strings == 3 and count is None:
            if not 1 <= size <= 64:
                return None
            count = size
            continue
        if at + size > len(data):
            return None
        at, strings = at + size, strings + 1
    return at - begin


def is_openssh(data: bytes) -> bool:
    """One such key, with nothing but zeros behind it."""
    size = _openssh_size(data)
    return size is not None and not data[size:].strip(b"\0")


def _decoded(run: bytes) -> bytes | None:
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def _json(run: bytes) -> dict:
    data = _decoded(run) or b""
    try:
        found = json.loads(data) if data[:1] == b"{" else None
    except (ValueError, RecursionError):
        found = None
    return found if isinstance(found, dict) else {}


def _kind(data: bytes | None) -> str | None:
    if data and data[0] == 0x30 and is_private_der(data):
        return "der"
    return "openssh" if data and data[0] == 0x6F and is_openssh(data) else None


def _bytes(run: bytes, hexed: bool) -> bytes:
    """What the characters of a run stand for, up to the last whole byte."""
    if not hexed:
        return _decoded(run[: len(run) - (len(run) % 4 == 1)]) or b""
    return bytes.fromhex(run[: len(run) // 2 * 2].decode())


class _Run:
    """What the characters of a run stand for, from any place on; it is decoded once for each alignment."""

    def __init__(self, run: bytes, hexed: bool):
        self.run, self.hexed, self.known = run, hexed, {}

    def at(self, place: int) -> tuple[bytes, int, int]:
        """(bytes, where those from a place on begin, where the zeros at the end begin)."""
        unit = 2 if self.hexed else 4
        if (first := place % unit) not in self.known:
            data = _bytes(self.run[first:], self.hexed)
            self.known[first] = (data, len(data.rstrip(b"\0")))
        data, zeros = self.known[first]
        return data, (place - first) // unit * (1 if self.hexed else 3), zeros

    def characters(self, size: int) -> int:
        return 2 * size if self.hexed else -(-size * 4 // 3)

    def element(self, place: int) -> tuple[bytes, int, int, int] | None:
        """(bytes, begin, end, end in the run) of the DER element that begins at a place of the run and ends in it."""
        data, at, _ = self.at(place)
        if len(data) - at < 6:
            return None
        more = data[at + 1] & 0x7F if data[at + 1] >= 0x80 else 0
        if more > 4:
            return None
        size = 2 + more + (int.from_bytes(data[at + 2 : at + 2 + more]) if more else data[at + 1] & 0x7F)
        end = place + self.characters(size)
        return (data, at, at + size, end) if end <= len(self.run) and at + size <= len(data) else None


def _inside(run: bytes, hexed: bool) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the keys at any place of a run; one that is a part of a larger structure is none."""
    whole, found, at = _Run(run, hexed), [], 0
    der, ssh, outer = (_DER16, _SSH16, _OUTER16) if hexed else (_DER64, _SSH64, _OUTER64)
    places, ahead, around = outer.finditer(run), None, []  # of larger structures: those to come, the next, and those that go on
    while m := der.search(run, at):
        at = m.start() + 1
        got = whole.element(m.start())
        if not got or not is_private_der(*got[:3]):
            continue
        while (ahead := ahead or next(places, None)) and ahead.start() < m.start():
            if o := whole.element(ahead.start()):
                around.append((ahead.start(), o))
            ahead = None
        begin = found[-1][2] if found else 0
        around = [(x, o) for x, o in around if x >= begin and o[3] >= got[3] and len(_elements(*o[:3]) or ()) == 1]
        if not around:
            found.append((m.start(), "der", got[3]))
        at = got[3]
    at = 0
    while m := ssh.search(run, at):
        at = m.end()
        data, begin, zeros = whole.at(m.start())
        if (size := _openssh_size(data, begin)) is not None:
            at = m.start() + whole.characters(size) if begin + size < zeros else len(run)
            found.append((m.start(), "openssh", at))
    return found


def _closes(text: str, at: int) -> bool:
    """Is what begins at a place an object with a key, at most DEEPEST brackets deep, of which the last closes at the end of the text?"""
    if not _KEY.match(text, at):
        return False
    depth = 0
    for m in _PART.finditer(text, at):
        if m[0] in "{[":
            depth += 1
            if depth > DEEPEST:
                return False
        elif m[0] in "}]":
            depth -= 1
            if not depth:
                return _BLANK.match(text, m.end()) is not None
    return False


def _tokens(b: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens, from whatever place in a run; a run is looked at once, not from each place in it."""
    marked = b.translate(_URL) if b"eyJ" in b else b""
    upto = lambda at: end if (end := marked.find(b" ", at)) >= 0 else len(b)
    s, end, tail, signed = b.find(b"eyJ"), -1, -1, False
    whole: dict[int, tuple[int, str]] = {}  # by alignment: the first place asked for and what the run holds from there on

    def header(s: int) -> dict:
        """The JSON object from s to the end of its run. Most places are told by what the object begins with, without reading on."""
        kind = (end - s) % 4
        if kind not in whole:
            whole[kind] = (s, (_decoded(b[s:end]) or b"").decode("latin-1"))
        base, text = whole[kind]
        return _json(b[s:end]) if _closes(text, (s - base) // 4 * 3) else {}

    while s >= 0:
        if s >= end:
            # what follows the header is the same for all places in its run
            end, tail = upto(s), -1
            whole.clear()
            body = upto(end + 1)
            if b[end : end + 1] == b"." and body > end + 1 and b[body : body + 1] == b".":
                tail = upto(body + 1)
                signed = tail > body + 1
        at = s + 1
        if tail < 0:
            at = end
        else:
            # a header is printable and ends with a bracket; its first and last characters tell most others
            head, close = _decoded(b[s : min(s + 16, end)]) or b"", _decoded(b[end - ((end - s) % 4 or 4) : end]) or b""
            if close[-1:] in (b"}", b" ", b"\n", b"\r", b"\t") and head and not any(c < 32 and c not in b"\t\n\r" for c in head):
                alg = header(s).get("alg")
                if isinstance(alg, str) and (signed or alg.lower() == "none"):
                    yield s, tail
                    at = tail
        s = b.find(b"eyJ", at)


def _is_pem(label: bytes, inner: bytes) -> bool:
    """Does what stands between the lines of a PEM block hold a key? Escaped line ends and header lines are left out."""
    for pattern, plain in _ESCAPES:
        inner = pattern.sub(plain, inner)
    lines = b"\n".join(x for x in inner.splitlines() if b":" not in x)
    for body in (lines, _HEADER.sub(b"", inner), b" ".join(x for x in inner.split() if b":" not in x)):
        data = _decoded(b"".join(body.split()).rstrip(b"="))
        if not data:
            continue
        if _kind(data) or b"ENCRYPTED" in label and is_encrypted_der(data):
            return True
        if len(data) >= 24 and len(data) % 8 == 0 and _ENCRYPTED.search(inner):
            return True
    return False


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind in KINDS, end) of all that is found in one text, sorted."""
    b = (text or "").encode("latin-1", "replace")
    found = []
    low = b.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(b) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in b:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(b) if m.end() - m.start() >= 20]
    found += [(s, 2, e) for s, e in _runs(b, _HEX, _MIN_HEX)]
    found += [(s, 3, e) for s, e in _tokens(b)]
    for s, e in _runs(b, _BASE64, _MIN_RUN):
        run = b[s:e]
        hexed = len(run) >= 2 * _MIN_HEX and len(run) % 2 == 0 and not run.translate(None, _ANY_HEX)
        if hexed:
            kind = _kind(bytes.fromhex(run.decode()))
        else:
            kind = _kind(_decoded(run)) if run[:1] in b"Mb" else None  # 0x30 and 'o' in base64
        if kind:
            keys = [(0, kind, len(run))]
        elif len(run) >= 32:
            keys = [] if hexed else _inside(run, False)
            for h in _HEX_RUN.finditer(run):
                keys += [(h.start() + x, k, h.start() + y) for x, k, y in _inside(h[0], True)]
        else:
            keys = []
        for x, kind, y in keys:
            pad = len(b[e : e + 2]) - len(b[e : e + 2].lstrip(b"=")) if y == len(run) else 0
            found.append((s + x, KINDS.index(kind), s + y + pad))
    begin = None
    for m in _MARK.finditer(b):
        if m[1] == b"BEGIN":
            begin = m
        elif begin and m[2] == begin[2]:
            if _is_pem(m[2], b[begin.end() : m.start()]):
                found.append((begin.start(), 6, m.end()))
            begin = None
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.array(KINDS)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [spans(t) for t in part.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([kinds.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, end) by start, then kind.

    Kinds come in the order of KINDS. Null text counts as empty and has an empty array. Rows are
    independent: repeated rows give repeated results, an empty table none. Other columns are ignored.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id with counts by base kind, the hash of the base spans, all spans, and the number confirmed by structure."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"),
    )
