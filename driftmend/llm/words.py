"""Words of many texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text; a longer text is a part by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit value for each number."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, first word of each text and the end, distinct words): words end at ASCII white space.

    Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    real = np.ones(len(codes), bool)
    if (blank := pc.index(coded.dictionary, "").as_py()) >= 0:
        real = codes != blank
    before = np.concatenate([[0], np.cumsum(real)])
    return codes[real], before[starts], coded.dictionary


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and the end)."""
    codes, starts, distinct = word_codes(texts)
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return table[codes] if len(codes) else np.empty(0, np.uint64), starts


@dataclass
class Cut:
    """Words of some texts, found byte by byte."""

    words: pa.Array  # distinct, as bytes
    codes: np.ndarray  # of each word, its place in words
    text: np.ndarray  # of each word, the number of its text
    at: np.ndarray  # of each word, its number in its text
    start: np.ndarray  # of each word, its first byte
    kind: np.ndarray  # of each byte
    firsts: np.ndarray  # where texts that aren't empty begin


def cut_words(texts: pa.Array, kinds: np.ndarray) -> Cut:
    """Runs of bytes of kind 0 in texts (null: empty) with A-Z in lower case. kinds: of each of the 256 bytes; those from 128 on are of words."""
    lower = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string()))
    ends = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = kinds[data]
    firsts = np.unique(ends[:-1][np.diff(ends) > 0])
    new = np.zeros(len(data), bool)
    new[firsts] = True
    inside = kind == 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | new[1:]
    stops[:-1] &= ~inside[1:] | new[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
    text = np.searchsorted(ends, start, "right") - 1
    at = np.arange(len(start)) - np.searchsorted(text, np.arange(len(lower)))[text]
    return Cut(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, at, start, kind, firsts)
