"""Token ids of whole texts, equal to ``Tokenizer.encode(text,
add_special_tokens=False)`` of a word-level BPE tokenizer with word ends.

Such a tokenizer cuts a normalized text into words and merges within a word only,
so a word has the same ids wherever it stands: a worker encodes each distinct
word once, and so each distinct piece between blanks, which is words and their
punctuation; a text's ids are gathered from its pieces', which are told apart by
64-bit hashes. That is done where the
tokenizer's normalizer does no more than lower-casing; a text with other characters, or
with a special token, goes through the library as it is."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from .common import give_back, hash_words

#: Distinct words, and distinct pieces, whose ids a task keeps; it starts anew when there are more.
CACHE_WORDS, CACHE_PIECES = 250_000, 300_000
#: Text that is encoded at once.
ENCODE_BYTES = 1 << 20
WORD_END = "</w>"

# The tokenizer's contractions and the blanks of its pattern.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
BLANKS = r" \t\n\x0b\x0c\r"
#: Characters that the normalizer lower-cases one by one and leaves else.
PLAIN = r"\x00-\x1b\x20-\x7fÀ-įı-ſ‐-‧€"


@functools.lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What is not plain; the words of a lower-cased plain text: contractions, runs
    of letters, single digits, runs of anything else but blanks."""
    odd = re.compile(f"[^{PLAIN}]")
    letters = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and re.match(f"[{PLAIN}]", c))
    return odd, re.compile("|".join([*CONTRACTIONS, f"[{letters}]+", "[0-9]", f"[^{BLANKS}0-9{letters}]+"]))


class _Ids(dict):
    """Text -> its number, by first appearance. ``new``: texts without ids yet; ids of number n: flat[start[n]:start[n + 1]]."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.flat, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        self[text] = n = len(self)
        return n

    def numbers(self, texts: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64, count)

    def learn(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.start = np.concatenate([self.start, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def gather(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers one after the other, and their ends."""
        size = self.start[n + 1] - self.start[n]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(n) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[n] - ends + size, size)], ends


class _Pieces:
    """Ids of the known pieces by their hashes, which are sorted: ``number`` tells
    where ``flat[start[n]:start[n + 1]]`` are the ids."""

    def __init__(self):
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids = _Ids()

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is known."""
        at = np.searchsorted(self.hashes, hashes)
        return at, self.hashes[np.minimum(at, len(self) - 1)] == hashes if len(self) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, at: np.ndarray) -> None:
        self.number = np.insert(self.number, at, np.arange(len(self), len(self) + len(hashes)))
        self.hashes = np.insert(self.hashes, at, hashes)


class _Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same merges for words that are cut and lower-cased already
        self.by_word = Tokenizer.from_file(path)
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.words, self.pieces = _Ids(), _Pieces()

    def ids(self, text: str, tok=None) -> np.ndarray:
        return np.array((tok or self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. New words take one call: each ends with its only token that has a word end."""
        if len(self.words) > CACHE_WORDS:
            self.words = _Ids()
        cut = list(map(_patterns()[1].findall, pieces))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        of = self.words.numbers(chain.from_iterable(cut), int(sizes.sum()))
        if self.words.new:
            ids = self.ids(" ".join(self.words.new), self.by_word)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(self.words.new):
                raise ValueError("this tokenizer has no word ends")
            self.words.learn(ids, ends)
        ids, ends = self.words.gather(of)
        self.pieces.ids.learn(ids, np.concatenate([[0], ends])[np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        odd = _patterns()[0]
        strange = [bool(t) and bool(odd.search(t) or self.special and self.special.search(t)) for t in texts]
        plain = [b"" if x or not t else t.lower().encode() for t, x in zip(texts, strange)]
        data, sizes = b"\n".join(plain), np.fromiter(map(len, plain), np.int64, len(plain))
        hashes, starts, ends = hash_words(np.frombuffer(data, np.uint8), np.empty(0, np.int64))
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = _Pieces()
        # each distinct piece of these texts is looked up once
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self.pieces.find(distinct)
        if not known.all():
            new = first[~known]
            self.learn([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            self.pieces.add(distinct[~known], at[~known])
            at = np.searchsorted(self.pieces.hashes, distinct)
        numbers = self.pieces.number[at][of]
        cuts = np.searchsorted(starts, np.cumsum(sizes + 1))
        for t, x, a, b in zip(texts, strange, [0, *cuts.tolist()], cuts.tolist()):
            yield self.ids(t) if x else self.pieces.ids.gather(numbers[a:b])[0]


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text; null and empty texts have none."""
    return _encoder(path).encode(texts)


def forget(path: str) -> None:
    """Free the ids that were kept, at the end of a task: other tasks of the worker need the memory."""
    encoder = _encoder(path)
    encoder.words, encoder.pieces = _Ids(), _Pieces()
    give_back()
