"""Language identification by cross-parsing entropy.

For each language one suffix automaton holds all substrings of a bounded sample of labelled text. A text is
parsed against it greedily: each phrase is the longest match from where the last one ended. Text in the
automaton's language parses into fewer, longer phrases, and the language whose phrases cost the fewest bits
(phrases times log2 of the sample's length) wins.

Letters are lower-cased, and runs of other characters count as one space. Every letter met in the samples is told
from all others. Texts are parsed in blocks of BLOCK characters, each from the root, so that the blocks of many
texts advance side by side; every character of a text is parsed. The automaton with its restarts is one table,
next state and whether a phrase begins, with a column for each of the DENSE commonest letters; moves by other letters,
of which a state has few, lie in one sorted list.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import held, held_out

CHARS, ROWS, BLOCK = 12_000, 64, 512  # sampled characters and rows per language at most; block
TOTAL, FEWEST = 480_000, 256  # sampled characters of all languages together, of which each has so many at least
DENSE = 60  # letters with a column of their own
UNKNOWN = "und"
_SOFT = 8.0  # bits by which a language must trail to weigh half as much in the score


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    alphabet: str  # letters by falling count, numbered from 2; 0 is any other character, 1 any other letter
    sizes: tuple[int, ...]
    roots: np.ndarray  # place in the table of each language's root
    table: np.ndarray  # at state + column: 2 * next state + (1 if a phrase begins)
    keys: np.ndarray  # state * classes + letter of each move by a letter without a column, sorted
    moves: np.ndarray  # what the table would hold there
    begins: np.ndarray  # a row for each language: what it would hold where no move continues

    @property
    def width(self) -> int:
        return min(len(self.alphabet), DENSE) + 2

    def rare(self, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The table for letters without a column: at has a row for each language."""
        wanted = at.astype(np.int64) * self.begins.shape[1] + letters
        place = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return np.where(self.keys[place] == wanted, self.moves[place], self.begins[:, letters])


def classes(text: str, alphabet: str) -> np.ndarray:
    """Class of each character that counts, with runs of non-letters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _collapsed(_class_table(alphabet)[points])


@functools.lru_cache(4)
def _class_table(alphabet: str) -> np.ndarray:
    table = _letters().astype(np.uint8 if len(alphabet) < 250 else np.uint32)
    table[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
    return table


def _collapsed(found: np.ndarray) -> np.ndarray:
    keep = found > 0
    keep[1:] |= found[:-1] > 0
    return found[keep]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def build(samples: dict[str, list[str]]) -> Model:
    """A model of the sample texts of each language."""
    counts: dict[str, int] = {}
    for texts in samples.values():
        for t in texts:
            for c in t.lower():
                if c.isalpha() and len(c) == 1:
                    counts[c] = counts.get(c, 0) + 1
    alphabet = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
    every, width = len(alphabet) + 2, min(len(alphabet), DENSE) + 2
    tables, roots, sizes, base, begins, rare = [], [], [], 0, [], {}
    for lang in sorted(samples):
        symbols = np.concatenate([np.zeros(1, np.int64), *(np.append(classes(t, alphabet), 0) for t in samples[lang])])
        symbols = _collapsed(np.concatenate([[1], symbols]).astype(np.int64))[1:]
        moves = automaton(symbols.tolist())
        restart = np.full(every, 2 * base + 1, np.int64)  # where no move continues, c begins a phrase
        for c, t in moves[0].items():
            restart[c] = 2 * (base + width * t) + 1
        table = np.repeat(restart[None, :width], len(moves), 0)  # of 64 bits until the size of all is known
        for s, m in enumerate(moves):
            for c, t in m.items():
                to = 2 * (base + width * t) + (s == 0)  # at the root each character begins a phrase
                if c < width:
                    table[s, c] = to
                else:
                    rare[(base + width * s) * every + c] = to
        tables.append(table.ravel())
        begins.append(restart)
        roots.append(base)
        sizes.append(len(symbols))
        base += table.size
    kind = np.int32 if base < 1 << 30 else np.int64
    keys = np.array(sorted(rare), np.int64)
    whole = np.concatenate([np.empty(0, kind), *tables], dtype=kind, casting="unsafe")
    return Model(
        tuple(sorted(samples)), alphabet, tuple(sizes), np.array(roots, kind), whole, np.append(keys, -1) if not len(keys) else keys,
        np.array([rare[k] for k in keys.tolist()] or [0], kind), np.array(begins, kind).reshape(len(tables), every),
    )


def phrases(texts: list[str], model: Model, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text, a row for each language; characters parsed, 0 for a text without a letter)."""
    symbols = [classes(t, model.alphabet) for t in texts]
    n = np.array([len(s) if s.any() else 0 for s in symbols], np.int64)
    lanes = np.where(n > 0, -(-n // block), 0)
    counts = np.zeros((len(model.langs), len(texts)), np.int64)
    total = int(lanes.sum())
    if not total or not model.langs:
        return counts, n
    of = np.repeat(np.arange(len(texts)), lanes)
    start = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    size = np.minimum(block, n[of] - start * block)
    by = np.argsort(-size, kind="stable")
    place = np.empty(total, np.int64)
    place[by] = np.arange(total)
    flat = np.concatenate([s for s, k in zip(symbols, n) if k])
    grid = np.zeros((block, total), flat.dtype)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    grid[step, np.repeat(place, size)] = flat
    common = np.where(grid < model.width, grid, 0).astype(np.uint8) if flat.max() >= model.width else grid
    active = np.searchsorted(-size[by], -np.arange(block), side="left")
    at = np.repeat(model.roots[:, None], total, 1)
    begun = np.zeros((len(model.langs), total), np.int32)
    for k in range(block):
        a = int(active[k])
        if not a:
            break
        got = model.table[at[:, :a] + common[k, :a]]
        if common is not grid and len(odd := np.flatnonzero(grid[k, :a] >= model.width)):
            got[:, odd] = model.rare(at[:, odd], grid[k, odd])
        begun[:, :a] += got & 1
        at[:, :a] = got >> 1
    for row, e in zip(counts, begun):
        row += np.bincount(of[by], e, len(texts)).astype(np.int64)
    return counts, n


def predict(texts: pa.Array, model: Model) -> pa.StructArray:
    """lang_pred and score of each text."""
    names, scores = [], []
    plain = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.utf8_length(plain).to_numpy(zero_copy_only=False)) // 2_000_000
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(plain)] if len(plain) else []
    for a, b in zip(cuts, cuts[1:]):
        counts, n = phrases(plain.slice(a, b - a).to_pylist(), model)
        if not model.langs:
            names += [UNKNOWN] * (b - a)
            scores += [0.0] * (b - a)
            continue
        bits = counts * np.log2(np.maximum(model.sizes, 2))[:, None]
        best = bits.argmin(0)
        share = 1 / np.exp2(-(bits - bits.min(0)) / _SOFT).sum(0)
        names += [model.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), n.tolist())]
        scores += np.where(n > 0, share, 0.0).tolist()
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])


def train(docs: DataFrame, chars: int = CHARS, rows: int = ROWS) -> Model:
    """Fit on documents that aren't held out and have a language.

    Per language at most `rows` distinct texts with a letter, chosen by hash, give at most chars / 16 characters each, from a
    place that their hash chooses, and `chars` together; where languages are more than TOTAL / chars, each gives TOTAL divided by their
    number, and not less than FEWEST, so that the model's size is bounded up to TOTAL / FEWEST languages and grows slowly beyond. The share drawn comes from the distinct texts, so copies
    don't crowd out the rest. Only these excerpts and a count for each language reach the driver.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = {r["lang"]: r["n"] for r in known.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build({})
    chars = min(chars, max(TOTAL // len(sizes), FEWEST))
    share = spark.createDataFrame([(k, min(1.0, 4 * rows / n)) for k, n in sizes.items()], "lang string, share double")
    place = F.pmod("hash", F.lit(1 << 30))
    size = max(chars // 16, 1)
    begin = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    inside, ahead = (F.regexp_extract(t, rf"(?s)\p{{L}}.{{0,{size - 1}}}", 0) for t in (F.substring("text", begin, F.lit(size)), F.col("text")))
    excerpt = F.when(inside != "", inside).otherwise(ahead)
    drawn = known.join(F.broadcast(share), "lang").filter(place <= F.col("share") * (1 << 30))
    found = drawn.select("lang", place.alias("place"), excerpt.alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {k: [] for k in sizes}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"], r["text"])):
        own = samples[r["lang"]]
        if len(own) < rows and sum(map(len, own)) < chars:
            own.append(r["text"])
    return build({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)})


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1), which replace columns of these names.

    Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Ties
    go to the first language by name. Rows are independent of each other and keep all other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def tell(texts: pa.Array) -> pa.Array:
        found = predict(texts, held(getattr, shared, "value"))
        pa.default_memory_pool().release_unused()
        return found

    tell = tell.asNondeterministic()  # it isn't, but else a filter on what it tells would run it twice
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "_told")]
    told = docs.withColumn("_told", tell(F.col("text").cast("string")))
    return told.select(*names, F.col("_told.lang_pred").alias("lang_pred"), F.col("_told.score").alias("score"))
