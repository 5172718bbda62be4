"""Token ids of many texts at once, by the tokenizers library.

Words recur, so each distinct piece between spaces is encoded once and remembered in the worker (up to
a bound). This is exact: a byte-level model cuts its input before a space that follows or precedes a
character that isn't white space, and a model that drops white space cuts at every space. A text with a cut
that isn't safe is encoded whole, as is one that holds the content of an added token (<|endoftext|>), which the library
finds in the raw text. The tests hold all of this against plain encoding.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from driftmend.llm.common import held

PIECES = 600_000  # remembered at most, in about 250 MB
_PLAIN = 20_000  # pieces encoded in one call
_HEAD = "\0"  # before a piece that begins a text


@functools.cache
def tokenizer(path: str, added: bool = False):
    """The library's own with added; else one that takes the contents of added tokens for plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not added
    return found


def _is_space(c: str) -> bool:
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


class PieceTokenizer:
    """Encodes texts by their pieces; spaced: a piece but the first is encoded with the space before it.

    added: the contents of added tokens are these tokens, as the library has it unless it is told otherwise.
    """

    def __init__(self, path: str, spaced: bool, added: bool = False):
        self.model, self.spaced = tokenizer(path), spaced
        self.whole = tokenizer(path, added)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        vocabulary = self.model.get_vocab()
        # a byte-level token has a letter for each byte
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token.removesuffix("</w>")) if not spaced else len(token)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.lead = np.empty(0, bool)
        self.trail = np.empty(0, bool)
        self.used = np.empty(0, np.int32)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids of each piece) of plain pieces encoded as one text; None if their bytes don't tell them apart."""
        text = " ".join(pieces)
        ids = np.array(self.model.encode_batch_fast([" " + text if self.spaced else text], add_special_tokens=False)[0].ids, np.uint32)
        if text.isascii():
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + self.spaced
        else:
            sizes = np.fromiter((len((p if self.spaced else p.lower()).encode()) for p in pieces), np.int64, len(pieces)) + self.spaced
        reached, ends = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
        cuts = np.searchsorted(reached, ends) + 1
        if not len(ids) or cuts[-1] != len(ids) or (reached[cuts - 1] != ends).any():
            return None
        return ids, np.diff(cuts, prepend=0)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, plain: int) -> None:
        """Remember pieces, of which the first `plain` neither begin nor end with white space."""
        first = len(self.number)
        self.number.update(zip(pieces, range(first, first + len(pieces))))
        edges, rest = np.zeros(plain, bool), pieces[plain:]
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.lead = np.concatenate([self.lead, edges, np.array([not p or _is_space(p[0]) for p in rest], bool)])
        self.trail = np.concatenate([self.trail, edges, np.array([not p or _is_space(p[-1]) for p in rest], bool)])

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: plain ones many at once, others one by one."""
        plain = [p for p in pieces if p and p.isprintable()]
        rest = [p for p in pieces if not p or not p.isprintable()]
        ids, sizes, order = [], [], []
        for at in range(0, len(plain), _PLAIN):
            part = plain[at : at + _PLAIN]
            if found := self._joined(part):
                order += part
                ids.append(found[0])
                sizes.append(found[1])
            else:
                rest += part
        done = len(order)
        if rest:
            alone = [e.ids for e in self.model.encode_batch_fast([p if not self.spaced else p[1:] if p[:1] == _HEAD else " " + p for p in rest], add_special_tokens=False)]
            ids.append(np.array([x for f in alone for x in f], np.uint32))
            sizes.append(np.array([len(f) for f in alone], np.int64))
        self._add(order + rest, np.concatenate(ids), np.concatenate(sizes), done)

    def _trim(self) -> None:
        """Forget the pieces met in one slice of texts only."""
        keep = self.used > 1
        if keep.sum() > PIECES // 2:
            return self.forget()
        self.number = {p: i for i, p in enumerate(itertools.compress(self.number, keep.tolist()))}
        size = np.diff(self.ends)
        self.ids = self.ids[np.repeat(keep, size)]
        self.ends = np.concatenate([[0], np.cumsum(size[keep])])
        self.lead, self.trail, self.used = self.lead[keep], self.trail[keep], self.used[keep] // 2
        return None

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; new ones are learned."""
        found = np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(found < 0)):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            found[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        self.used[found] += 1
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, start of each text's and the end). Null texts have none."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > PIECES:
            self._trim()
        at = self._numbers(distinct)[coded.indices.to_numpy(zero_copy_only=False)]
        odd = np.zeros(len(texts), bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if self.spaced:
            first = starts[:-1]
            unsafe = np.zeros(len(at), bool)
            unsafe[1:] = self.trail[at[:-1]] & self.lead[at[1:]]
            unsafe[first] = False
            heads = [distinct[i] for i in coded.indices.take(pa.array(first)).to_pylist()]
            marked = pc.starts_with(coded.dictionary, _HEAD).to_numpy(zero_copy_only=False)
            if marked.any():  # such a piece can't be told from a first one
                unsafe |= marked[coded.indices.to_numpy(zero_copy_only=False)]
            odd[np.searchsorted(first, np.flatnonzero(unsafe), side="right") - 1] = True
            # the first piece of a text has no space before it
            at[first] = self._numbers([_HEAD + h for h in heads])
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        out_start = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - out_start[:-1], size) + np.arange(int(out_start[-1]))]
        ends = out_start[starts]
        whole = np.flatnonzero(odd).tolist()
        if not whole:
            return ids, ends
        parts = np.split(ids, ends[1:-1])
        for i, e in zip(whole, self.whole.encode_batch_fast([texts[i].as_py() for i in whole], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def piece_tokenizer(path: str, spaced: bool) -> PieceTokenizer:
    """One for a worker process, with added tokens."""
    return held(PieceTokenizer, path, spaced, True)
