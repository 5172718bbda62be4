"""Token ids in files: canonical length-limited Huffman coding.

Code lengths come from the counts of all ids of the corpus by package-merge, so that no code is longer than
the limit; codes follow from the lengths alone (shorter first, then by id). Documents lie in ascending
doc_id order in shards, each a run of blocks. A block holds whole documents, about BLOCK ids, and
decodes by itself; the bit offset of every STEP-th id is kept, so all stretches between these
checkpoints are decoded side by side through one table of 2**limit entries.

A folder in this format has three Parquet tables: blocks (shard, block, first, doc_ids, sizes, checkpoints,
payload), codebook (id, bits) and shards (shard, before).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftmend.llm.common import frugal, written
from driftmend.llm.tokens import piece_tokenizer, tokenizer
from driftmend.llm.words import slices

LIMIT, BLOCK, STEP = 20, 1 << 16, 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each id by package-merge; 0 for ids that don't occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    limit = max(limit, int(len(ids) - 1).bit_length())
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, items = [np.ones(len(leaves), bool)], leaves
    for _ in range(limit - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        items = both[by]
    bits, need = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for leaf in reversed(levels):
        taken = int(leaf[:need].sum())
        bits[:taken] += 1
        need = 2 * (need - taken)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the order of their codes, code of each id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = int(lengths.max(initial=1))
    steps = np.left_shift(1, width - lengths[order].astype(np.int64))
    at = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(order) else np.empty(0, np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (at >> (width - lengths[order].astype(np.int64))).astype(np.uint64)
    return order, codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, most significant first; bit offset of every STEP-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    word = start >> 5
    value = codes[ids] << (np.uint64(64) - size.astype(np.uint64) - (start & 31).astype(np.uint64))
    n = (total >> 5) + 2
    # codes share no bit, so these sums stay below 2**32 and are exact
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], start[::STEP]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        order, _ = canonical(lengths)
        self.width = int(lengths.max(initial=1))
        room = np.left_shift(1, self.width - lengths[order].astype(np.int64))
        self.ids, self.bits = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.uint8)
        n = int(room.sum())
        self.ids[:n], self.bits[:n] = np.repeat(order, room), np.repeat(lengths[order], room)

    def decode(self, payloads: list[bytes], sizes: list[int], checkpoints: list[np.ndarray]) -> np.ndarray:
        """The ids of several blocks, one after the other."""
        data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        first = np.concatenate([[0], np.cumsum([len(p) + 8 for p in payloads])[:-1]]) * 8
        at = np.concatenate([c + f for c, f in zip(checkpoints, first)]).astype(np.int64)
        left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(len(c))) for n, c in zip(sizes, checkpoints)]).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(left)[:-1]])
        by = np.argsort(-left, kind="stable")
        at, to, left = at[by], to[by], left[by]
        out = np.empty(sum(sizes), np.uint32)
        shift, mask = 32 - self.width, (1 << self.width) - 1
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k, side="left"))
            code = (window[at[:n] >> 3] >> (shift - (at[:n] & 7))) & mask
            out[to[:n] + k] = self.ids[code]
            at[:n] += self.bits[code]
        return out


def _width(path: str, end: int) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, path: str, end: int, spaced: bool) -> DataFrame:
    """doc_id and ids (little-endian, of _width), with the end id."""
    width = _width(path, end)
    last = np.array([end], width).tobytes()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_tokenizer(path, spaced)
        for batch in batches:
            for part in slices(batch):
                ids, ends = model.encode(part.column("text"))
                ids = ids.astype(width)
                data = [ids[a:b].tobytes() + last for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "ids"])

    return slim.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary")


def _counts(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                n = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), width))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 2, spaced: bool = False) -> None:
    """Encode the texts of docs and write the folder; null text counts as empty (the end id alone).

    Null doc_ids come first; rows that repeat a doc_id are separate documents, in the order of a hash of their ids. A doc_id that
    many rows share is spread over many ranges.
    An empty table gives a folder without blocks. The counts, one for each id of the vocabulary, and the size of
    each shard are all that reaches the driver.
    """
    spark = docs.sparkSession
    width = _width(path, end)
    # rows that repeat each other are told apart by a number that is written with them, so that no range must hold them all
    table = written(token_table(docs, path, end, spaced).withColumn("row", F.monotonically_increasing_id()), "tokens")
    found = table.mapInArrow(_counts(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    codes = canonical(lengths)[1]
    kind = table.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(table.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, checkpoints = encode(ids, lengths, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block]), pa.array([first]), pa.array([docs], pa.list_(arrow)), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["shard", "block", "first", "doc_ids", "sizes", "checkpoints", "payload"],
            )

        held = 0
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                parts.append(np.frombuffer(data, width))
                held += len(parts[-1])
                if held >= BLOCK:
                    yield flush()
                    block, first, held, docs, parts = block + 1, first + held, 0, [], []
        if docs:
            yield flush()

    schema = f"shard int, block long, first long, doc_ids array<{kind}>, sizes array<long>, checkpoints array<long>, payload binary"
    spread = table.withColumn("spread", F.xxhash64("ids"))
    spread.repartitionByRange("doc_id", "spread", "row").sortWithinPartitions("doc_id", "spread", "ids").mapInArrow(run, schema).write.parquet(f"{folder}/blocks")
    ids = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in ids], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    shards, total = [], 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        shards.append((r["shard"], total))
        total += r["n"]
    spark.createDataFrame(shards, "shard int, before long").coalesce(1).write.parquet(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder: doc_id, start (ids before it), n_tokens, ids_crc32 (and ids, little-endian)."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(spark.read.parquet(f"{folder}/shards")), "shard")
    blocks = blocks.select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "sizes", "checkpoints", "payload")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for part in slices(batch, "payload", 2_000_000):
                sizes = part.column("sizes").to_pylist()
                flat = np.array([n for s in sizes for n in s], np.int64)
                ids = decoder.decode(part.column("payload").to_pylist(), [sum(s) for s in sizes], [np.array(c) for c in part.column("checkpoints").to_pylist()]).astype("<u4")
                ends = np.cumsum(flat)
                starts = np.concatenate([b + np.concatenate([[0], np.cumsum(s)[:-1]]) for b, s in zip(part.column("start").to_pylist(), sizes)])
                data = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), flat.tolist())]
                out = [part.column("doc_ids").flatten(), pa.array(starts.astype(np.int64)), pa.array(flat), pa.array([zlib.crc32(d) for d in data], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(data, pa.binary())] if with_ids else out, names=names)

    return blocks.mapInArrow(frugal(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
