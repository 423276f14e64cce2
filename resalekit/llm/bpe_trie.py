"""BPE encoding by a trie of the distinct words, and decoding (operator 12).

A sequence of tokens is the encoding of its text if each token, and each two
neighbours, are the encoding of theirs: merges within a part go on in the order
of ranks as they do alone, so none ever crosses a border that the two neighbours
alone would keep. So an encoding goes on from the last token only: of the
tokens that end a prefix there is one that is compatible with the last token of
the prefix before it, and that is the prefix's last token.

The distinct words of a slice, sorted, are inserted into a trie whose edges are
the tails of words. It is walked depth first with the last tokens of the path
from the root, so the tokens of a shared prefix are found once; a word's ids are
read back from its leaf, a token at a time. The last byte of a word, with the word's end, is another
symbol than the same byte within a word."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .tokens import CACHE_WORDS, ENCODE_BYTES, WORD_END, _Encoder, _Ids, _Pieces, _patterns

#: Pairs of tokens whose compatibility a task keeps; it starts anew when there are more.
CACHE_PAIRS = 1_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Trie:
    """Sorted words of symbols; edge n is the tail of word n, which leaves the
    path of word n - 1 at depth[n]."""

    def __init__(self):
        self.depth: list[int] = []
        self.tail: list[list[int]] = []
        self._path: list[int] = []

    def insert(self, word: list[int]) -> None:
        """``word`` must not come before the last one."""
        at, path = 0, self._path
        most = min(len(path), len(word))
        while at < most and path[at] == word[at]:
            at += 1
        self.depth.append(at)
        self.tail.append(word[at:])
        self._path = word


class Merges:
    """Ranks of merges, and which tokens end where."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = WORD_END):
        names = byte_symbols()
        self.inner = [vocab[c] for c in names]
        self.last = [vocab[c + end] for c in names]
        inner = dict(zip(names, self.inner))

        def spelled(token: str) -> tuple[int, ...]:
            if not token.endswith(end):
                return tuple(map(inner.__getitem__, token))
            token = token[:-len(end)]
            return (*map(inner.__getitem__, token[:-1]), vocab[token[-1] + end])

        symbols = {v: (v,) for v in [*self.inner, *self.last]}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (rank, z))
            symbols.setdefault(z, spelled(a + b))
        self.symbols = symbols
        # tokens by their symbols from the last one on: node -> symbol -> node; node -> token
        self.back: list[dict[int, int]] = [{}]
        self.token = [-1]
        for token, own in symbols.items():
            if self.merged(list(own)) != [token]:
                continue  # no text is ever encoded as this token
            node = 0
            for s in reversed(own):
                node = self.back[node].setdefault(s, len(self.back))
                if node == len(self.token):
                    self.back.append({})
                    self.token.append(-1)
            self.token[node] = token
        self.fits: dict[int, bool] = {}  # a << 32 | b -> whether they are compatible

    def merged(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges: the lowest rank first, of equal ones the leftmost."""
        rank = self.rank
        while len(ids) > 1:
            best = min(((*rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            ids[best[2]:best[2] + 2] = [best[1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` is encoded as these two."""
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        found = (a, b) not in self.rank and self.merged([*self.symbols[a], *self.symbols[b]]) == [a, b]
        self.fits[a << 32 | b] = found
        return found

    def walk(self, trie: Trie) -> Iterator[list[int]]:
        """The ids of each inserted word. ``last[d]`` is the last token of the path's
        first d symbols, and ``size[d]`` its symbols."""
        path: list[int] = []
        last, size = [-1], [0]
        back, token, known, fits = self.back, self.token, self.fits.get, self.compatible
        for depth, tail in zip(trie.depth, trie.tail):
            del path[depth:], last[depth + 1:], size[depth + 1:]
            for symbol in tail:
                path.append(symbol)
                end = at = len(path)
                node = 0
                while at:
                    at -= 1
                    node = back[node][path[at]]
                    t = token[node]
                    if t >= 0:
                        if not at:
                            break
                        a = last[at]
                        fit = known(a << 32 | t)
                        if fits(a, t) if fit is None else fit:
                            break
                last.append(t)
                size.append(end - at)
            at, out = len(path), []
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            yield out


class _TrieEncoder(_Encoder):
    """Encodes new words by the trie; cutting texts into words, and what is kept
    of words and pieces, are shared with the other encoders. The library
    normalizes and cuts texts with uncommon characters."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != WORD_END or model["type"] != "BPE":
            raise ValueError("this tokenizer has no word ends")
        self.tok = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.names = {c: b for b, c in enumerate(byte_symbols())}
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.text_of = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.words, self.pieces = _Ids(), _Pieces()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these distinct words one after the other, and their ends."""
        own = list(map(str.encode, words))
        order = sorted(range(len(own)), key=own.__getitem__)
        trie, inner, last = Trie(), self.merges.inner, self.merges.last
        for n in order:
            symbols = list(map(inner.__getitem__, own[n]))
            symbols[-1] = last[own[n][-1]]
            trie.insert(symbols)
        found: list[list[int]] = [[]] * len(own)
        for n, ids in zip(order, self.merges.walk(trie)):
            found[n] = ids
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) if len(ends) else 0), ends

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        of = self.words.numbers(words, len(words))
        if self.words.new:
            self.words.learn(*self.encode_words(self.words.new))
        return self.words.gather(of)

    def learn(self, pieces: list[str]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words = _Ids()
        cut = list(map(_patterns()[1].findall, pieces))
        ids, ends = self._of_words([w for own in cut for w in own])
        at = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        self.pieces.ids.learn(ids, np.concatenate([[0], ends])[at])

    def ids(self, text: str, tok=None) -> np.ndarray:
        """A text with uncommon characters: the parts between special tokens are
        normalized and cut by the library."""
        if len(self.words) > CACHE_WORDS:
            self.words = _Ids()
        out, at, names = [], 0, self.names
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            part = self.tok.normalizer.normalize_str(text[at:m.start() if m else len(text)])
            words = [bytes(map(names.__getitem__, w)).decode() for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
            out.append(self._of_words(words)[0])
            if m:
                out.append(np.array([self.added[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the tokens, as the library gives it for a tokenizer without a decoder: blanks between them."""
        return b" ".join(map(self.text_of.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _TrieEncoder:
    return _TrieEncoder(path)


def encode(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text; null and empty texts have none."""
    return _encoder(path).encode(texts)


def decode(ids: np.ndarray, path: str) -> str:
    """The text of these ids, special tokens too."""
    return _encoder(path).decode(ids).decode()


def _forget(path: str) -> None:
    encoder = _encoder(path)
    encoder.words, encoder.pieces = _Ids(), _Pieces()
    encoder.merges.fits.clear()
    give_back()


def encode_documents(docs: DataFrame, tokenizer: str, decoded: bool = True) -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit integers, little endian) and, if asked for, text decoded
    from them, one row per row of ``docs``, in which order it comes.

    Ids equal ``Tokenizer.encode(text, add_special_tokens=False)``, the text
    ``Tokenizer.decode(ids, skip_special_tokens=False)``, for word-level BPE with word
    ends and no decoder. Null and empty texts: no ids, empty text. Long texts are encoded
    whole; a task holds one at a time. Repeated rows and null ids are rows of their own. No rows: none.
    Other columns are not read. Nothing is shuffled; a lost task starts anew."""
    names = ["doc_id", "ids", *["text"] * decoded]

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                ids = list(encoder.encode(part.column("text").to_pylist()))
                cols = [part.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    cols.append(pa.array([encoder.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)
        _forget(tokenizer)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, ids binary" + ", text string" * decoded)


def decode_documents(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` as ``encode_documents`` writes them; null ids: null."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "ids", ENCODE_BYTES):
                texts = [None if x is None else encoder.decode(np.frombuffer(x, "<u4")).decode() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
