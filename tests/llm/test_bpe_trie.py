import random

import numpy as np
import pytest

from helpers import ODD, collect, documents, extra, prose
from resalekit.llm import bpe_trie

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def plain(vocab, merges, word):
    """BPE as it is defined: merge after merge over the whole word."""
    own = [*word[:-1], word[-1] + "</w>"]
    ranks = {m: n for n, m in reversed(list(enumerate(merges)))}
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(own, own[1:])) if p in ranks]:
        i = min(pairs)[1]
        own[i:i + 2] = [own[i] + own[i + 1]]
    return [vocab[t] for t in own]


@pytest.mark.parametrize("seed", range(6))
def test_trie_equals_merging_for_random_merges(seed):
    # merges in any order, and tokens that several merges make
    rng = random.Random(seed)
    names = bpe_trie.byte_symbols()
    tokens = [*names, *(c + "</w>" for c in names)]
    merges, known = [], ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    while len(merges) < 120:
        a, b = rng.choice(known), rng.choice(known)
        if not a.endswith("</w>") and len(a + b) < 14 and (a, b) not in merges:
            merges.append((a, b))
            known.append(a + b)
    rng.shuffle(merges)
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*tokens, *known]))}
    rules = bpe_trie.Merges(vocab, merges)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 25))) for _ in range(800)})
    trie = bpe_trie.Trie()
    for w in words:
        symbols = [rules.inner[b] for b in w.encode()]
        symbols[-1] = rules.last[w.encode()[-1]]
        trie.insert(symbols)
    assert sum(map(len, trie.tail)) < sum(map(len, words))  # shared prefixes are there once
    assert list(rules.walk(trie)) == [plain(vocab, merges, w) for w in words]


def test_ids_and_texts_equal_the_library(library):
    rng = random.Random(1)
    alphabet = "aAbBÉéß Σσİı \n\t\r\x0b\x1c\x85\xa0​́'’sStTrReEvVlLmMdD12½漢ㄱ<|>endoftext.,!?…€"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["a<|endoftext|>b<|startoftext|>", "it's WE'LL i'd", "x" * 3000, "thethe" * 300, *[t for t in ODD if t]]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe_trie.encode(texts, PATH)] == want
    assert [bpe_trie.decode(np.array(x, np.uint32), PATH) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert [x.tolist() for x in bpe_trie.encode([None, ""], PATH)] == [[], []]


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe_trie, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe_trie, "CACHE_PAIRS", 2)
    for t in ["alpha beta, gamma", "delta alpha! beta", "beta; beta epsilon 漢字"] * 2:
        assert [x.tolist() for x in bpe_trie.encode([t], PATH)] == [library.encode(t, add_special_tokens=False).ids]


def test_documents_and_round_trip(spark, library):
    texts = [*ODD, prose(3000), "same", "same", "z" * 200_000]
    rows = [*enumerate(texts), (None, "no id"), (5, "twice"), (5, "twice")]
    found = bpe_trie.encode_documents(extra(documents(spark, rows)), PATH)
    assert found.columns == ["doc_id", "ids", "text"]
    got = collect(found)
    assert len(got) == len(rows)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=str) == want
    assert all(r["text"] == library.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in got)
    ids = bpe_trie.encode_documents(documents(spark, rows), PATH, decoded=False)
    again = collect(bpe_trie.decode_documents(ids, PATH))
    assert sorted(((r["doc_id"], r["text"]) for r in again), key=str) == sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    assert bpe_trie.encode_documents(documents(spark, []), PATH).count() == 0
