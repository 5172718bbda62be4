"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut at the sequence length; whole pieces are sequences of their own.
The remainders, cut once more where longer than `piece`, are dealt by hash into groups of bounded size, and each
group is divided into as few windows as hold it: every piece starts as a partial partition with one filled
window, and the two partial partitions that are most uneven are merged again and again, fullest windows onto
emptiest, so that imbalances cancel. If the fullest window of the result exceeds the capacity, the window count
rises and the group is divided anew.

Pieces that are alike in all columns are counted first and dealt as copy 1, 2, ..., so a row that is repeated without end
spreads over all groups, and a rerun deals the same.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import frugal, written
from driftmend.llm.tokens import piece_tokenizer
from driftmend.llm.words import slices

_SUM = itemgetter(0)

LENGTH, PIECE, GROUP, END = 1024, 512, 720, 0


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Divide sizes into so many windows of near-equal sums: the indices of each."""
    heap, order = [], 0
    for i, s in enumerate(sizes):
        heap.append((-s if windows > 1 else 0, order, [(s, [i])]))  # filled windows only, fullest first
        order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - windows  # so many windows are filled on both sides
        if meet <= 0:
            merged = a + b
        else:
            alone, both = len(a) - meet, len(b) - meet
            merged = a[:alone] + b[:both] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone:], reversed(b[both:]))]
        merged.sort(key=_SUM, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    return [w[1] for w in heap[0][2]] if heap else []


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """As differencing, with the least window count tried for which no sum exceeds the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        count += 1


def _pieces(total: int, length: int, piece: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of so many ids."""
    found, at = [], 0
    while at < total:
        left = total - at
        size = length if left >= length else min(left, piece)
        found.append((at, size))
        at += size
    return found


def pieces(docs: DataFrame, path: str, length: int = LENGTH, piece: int = PIECE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids: doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian)."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_tokenizer(path, True)
        for batch in batches:
            for part in slices(batch):
                ids, ends = model.encode(part.column("text"))
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for start, size in _pieces(len(own), length, piece):
                        data = own[start : start + size].tobytes()
                        rows.append((i, start, size, zlib.crc32(data), len(own), data if with_ids else None))
                at, *columns, data = zip(*rows)
                out = [part.column("doc_id").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(data, pa.binary())] if with_ids else out, names=[*names, "ids"] if with_ids else names)

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return slim.mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, piece: int = PIECE, group: int = GROUP, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts have the end id alone. Rows that repeat each other are packed as documents of
    their own, and every id of every row lies in exactly one piece. sequence_id is unique, not dense. An
    empty table gives no rows; other columns are ignored. A sequence is padded to `length`, unless
    its size is a power of two. Reruns give the same rows.
    """
    cut = written(pieces(docs, path, length, piece, end, with_ids), "pack-pieces")
    names = cut.columns
    whole = F.col("length") == length
    n = cut.groupBy(whole.alias("whole")).agg(F.count("*").alias("n")).collect()
    groups = {w: max(1, -(-sum(r["n"] for r in n if r["whole"] == w) // group)) for w in (False, True)}
    alike = cut.groupBy(*names).agg(F.count("*").alias("_n"))
    each = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    place = F.xxhash64(*names, "_copy")
    dealt = each.withColumn("group", F.when(whole, F.pmod(place, F.lit(groups[True])) + groups[False]).otherwise(F.pmod(place, F.lit(groups[False])))).withColumn("place", place).drop("_n", "_copy")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "start"], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        sequence, offset = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        if sizes[0] < length:
            for w, members in enumerate(windows_for(sizes.tolist(), length)):
                sequence[members] = w
                offset[members] = np.concatenate([[0], np.cumsum(sizes[members])[:-1]])
        first = int(rows["group"].iloc[0]) << 32
        return rows.drop(columns=["group", "place"]).assign(sequence_id=sequence + first, offset=offset)

    return dealt.groupBy("group").applyInPandas(divide, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """sequence_id, size and ids (array<int>, padded) of a packing made with ids; at most `length` ids each."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    digits = lambda b, i: F.hex(F.substring(b, i * 4 + 1, 4))
    number = lambda b, i: F.conv(F.concat(*[F.substring(digits(b, i), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    ids = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), (p["length"] - 1).cast("int")), lambda i: number(p["ids"], i))))
    power = F.bit_count("size") == 1
    return whole.select("sequence_id", size.alias("size"), ids.alias("ids")).withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), (F.lit(length) - F.col("size")).cast("int")))))
