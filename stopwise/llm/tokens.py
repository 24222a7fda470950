"""Token ids of many texts by the ``tokenizers`` library, with a bounded cache of words.

Texts are cut at ASCII white space, which the tokenizers in use drop and which no rule of theirs spans, and ids are looked up
by word; words not seen are encoded by the tokenizer itself, as it was loaded. Words of ASCII alone are looked up in lower case; others, and
those with a ``<`` (special tokens are told apart by case), are left as they are, because the tokenizer composes letters before
it lower-cases them.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Token ids of white-space separated words, through a cache of ``most`` words and ``most_bytes`` of text, about.

    The cache is a number for each word, and the words' ids one after another. When full it keeps the half of its words
    that most slices had.
    """

    def __init__(self, path: str, most: int = 300_000, most_bytes: int = 12 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.most, self.most_bytes = most, most_bytes
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)  # one more than there are words
        self.hits = np.zeros(1 << 14, np.int32)
        self.known = self.bytes = 0

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.hits[: self.known], kind="stable")[: self.most // 2])
        words, size = list(self.number), np.diff(self.start[: self.known + 1])
        words = [words[i] for i in keep.tolist()]
        ids, size, hits = self.ids[ranges(self.start[keep], size[keep])], size[keep], self.hits[keep]
        self.clear()
        if sum(map(len, words)) <= self.most_bytes // 2:
            self._add(words, ids, size)
            self.hits[: len(hits)] = hits // 2

    def rest(self) -> None:
        """Between tasks, for the worker's next one: half a full cache's words stay, those that most slices had, and no more."""
        if self.known:
            self._shrink()

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        end = int(self.start[self.known])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:end], np.empty(end + 2 * len(ids), np.uint32)))
        if self.known + len(words) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros(self.known + 2 * len(words), np.int64)))
            self.hits = np.concatenate((self.hits, np.zeros(len(self.start) - len(self.hits), np.int32)))
        self.ids[end : end + len(ids)] = ids
        self.start[self.known + 1 : self.known + 1 + len(words)] = end + np.cumsum(size)
        self.number.update(zip(words, range(self.known, self.known + len(words))))
        self.known += len(words)
        self.bytes += sum(map(len, words))

    def _learn(self, words: list[bytes]) -> None:
        """Words that are one run of letters are encoded many at once and told apart by their end marks."""
        text = [w.decode() for w in words]
        runs = [i for i, t in enumerate(text) if t.isalpha() and (t.isascii() or unicodedata.is_normalized("NFC", t))]
        other = sorted(set(range(len(words))) - set(runs))
        for k in range(0, len(runs), 1000):
            part = runs[k : k + 1000]
            ids = np.array(self.encoder.encode(" ".join([text[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                self._add([words[i] for i in part], ids, np.diff(last, prepend=-1))
            else:  # the tokenizer takes some letter for something else
                other += part
        for k in range(0, len(other), 1000):
            part = other[k : k + 1000]
            got = [e.ids for e in self.encoder.encode_batch([text[i] for i in part], add_special_tokens=False)]
            self._add([words[i] for i in part], np.array(list(chain.from_iterable(got)), np.uint32), np.array([len(g) for g in got]))

    def encode(self, words: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words[index[0]], words[index[1]], ..., and the number of ids of each. ``words`` are distinct."""
        new = [w for w in words if w not in self.number]
        if self.known and (self.known + len(new) > self.most or self.bytes > self.most_bytes):
            self._shrink()
            new = [w for w in words if w not in self.number]
        self._learn(new)
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.hits[which] += 1
        which = which[index]
        size = np.diff(self.start[: self.known + 1])[which]
        return self.ids[ranges(self.start[which], size)], size


_KIND = np.zeros(256, np.uint8)  # 1: white space, 2: A-Z and a-z, 3: comma and full stop
_KIND[[0x20, 9, 10, 11, 12, 13]] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[[0x2C, 0x2E]] = 3
#: Bytes whose words keep their case.
_AS_IS = np.zeros(256, bool)
_AS_IS[128:] = _AS_IS[ord("<")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, the word at each place, and how many each text has.

    A comma or full stop between a letter and white space is made a word of its own, as it is a token of its own:
    words then recur more often.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    kind = _KIND[data]
    black = kind != 1
    first = black.copy()
    first[1:] &= ~black[:-1]
    mark = np.flatnonzero(kind == 3)
    mark = mark[(mark > 1) & (kind[np.minimum(mark + 1, len(data) - 1)] == 1)]
    latin = (data[mark - 2] == 0xC3) & (data[mark - 1] >= 0x80) & (data[mark - 1] != 0x97) & (data[mark - 1] != 0xB7)  # letters of two bytes
    first[mark[(kind[mark - 1] == 2) | latin]] = True
    begins = np.flatnonzero(first[black])  # among bytes that are not white space
    letters = data[black]
    offsets = np.append(begins, len(letters)).astype(np.int32)
    lower = _LOWER[letters]
    kept = np.flatnonzero(_AS_IS[letters])
    if len(kept):
        word = np.unique(np.searchsorted(begins, kept, side="right") - 1)
        at = ranges(begins[word], np.diff(offsets)[word])
        lower[at] = letters[at]
    column = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(lower)]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    before = np.searchsorted(np.flatnonzero(first), ends)
    return column.dictionary.to_pylist(), column.indices.to_numpy(), np.diff(before, prepend=0)


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def ids_of(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and how many each text has."""
    words, index, count = words_of(texts)
    ids, n = tokens(path).encode(words, index)
    ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(count)]
    return ids, np.diff(ends, prepend=0)


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids_of`` with the id ``end`` after each text."""
    size = n + 1
    own = np.full(int(size.sum()), end, "<u4")
    own[ranges(np.cumsum(size) - size, n)] = ids
    return own, size
