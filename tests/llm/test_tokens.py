import random

import numpy as np
import pytest

from helpers import ODD, collect, documents, extra, prose
from resalekit.llm import packing, token_files, tokens

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def library(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_on_odd_texts():
    from tokenizers import Tokenizer
    tok, rng = Tokenizer.from_file(PATH), random.Random(1)
    alphabet = "aAbBÉéß Σσİı \n\t\r\x0b\x1c\x85\xa0​́'’sStTrReEvVlLmMdD12½漢ㄱ<|>endoftext.,!?…€"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "it's WE'LL i'd", "x" * 3000] + [t for t in ODD if t]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == want
    assert [x.tolist() for x in tokens.encode([None, ""], PATH)] == [[], []]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    texts = ["alpha beta, gamma", "delta alpha! beta", "beta; beta epsilon"]
    for t in texts * 2:
        assert [x.tolist() for x in tokens.encode([t], PATH)] == [library(t)]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_chunk_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    for x in (ids, ids % 50000, ids * 0):
        assert (token_files.unpack_chunk(memoryview(token_files.pack_chunk(x, planes))) == x).all()


@pytest.mark.parametrize("planes,block", [("bit", 64), ("byte", 1 << 16)])
def test_files_round_trip(spark, tmp_path, planes, block):
    texts = [*ODD, "the cat", "the cat", prose(300)]
    rows = [(i * 3 % 7 * 100 + i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    token_files.write_token_files(extra(documents(spark, rows)), str(tmp_path / "f"), PATH, block=block, planes=planes)
    got = collect(token_files.read_token_files(spark, str(tmp_path / "f")))
    assert len(got) == len(rows)
    ids = {(r["start"], r["doc_id"]): r for r in got}
    start = 0
    for key in sorted(ids, key=lambda k: k[0]):
        r = ids[key]
        assert r["start"] == start
        start += r["n_tokens"]
        wants = [library(t) + [1] for i, t in rows if i == r["doc_id"]]
        assert r["ids"] in wants and len(r["ids"]) == r["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known) and sorted(got, key=lambda r: r["start"])[0]["doc_id"] is None


def test_files_are_rolled_and_one_doc_id_is_split(spark, tmp_path):
    """A third of the rows has no doc_id, many of them are equal; one document is longer than a whole file."""
    rows = [(None, "same words again" if i % 2 else prose(i % 9, i)) for i in range(150)] + [(i * 7 % 300, prose(i % 40, i)) for i in range(300)]
    rows += [(500, prose(2000, 4)), (501, "")]
    path = str(tmp_path / "f")
    token_files.write_token_files(documents(spark, rows), path, PATH, block=32, rows_per_file=5, task_bytes=2000)
    files = [f for f in (tmp_path / "f").iterdir() if f.name.startswith("part-")]
    assert len(files) > 60 and len({token_files._place(f.name)[0] for f in files}) < len(files)
    nulls, longest = 0, 0
    for f in files:
        docs, index = token_files._footer(f.read_bytes())
        assert len(index) <= 4 and (docs["n"].sum() <= 4 * 32 or len(docs) == 1) and docs["n"].sum() == index["n"].sum()
        nulls += not docs["known"].all()
        longest = max(longest, len(docs))
    assert nulls > 5
    got = sorted(collect(token_files.read_token_files(spark, path)), key=lambda r: r["start"])
    assert len(got) == len(rows) and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    want = sorted((i is not None, i or 0, library(t) + [1]) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == want


def test_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(documents(spark, []), str(tmp_path / "f"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "f")).count() == 0


def check_windows(lengths, windows, longest):
    pieces = {}
    for size, window in windows:
        assert sum(n for _, _, n in window) == size <= longest and size & (size - 1) == 0
        for doc, start, n in window:
            assert n > 0
            pieces.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces.get(doc, [])):
            assert start == at
            at += k
        assert at == n


@pytest.mark.parametrize("lengths", [[], [1], [64] * 3, [1] * 100, [65, 1, 63], [1000, 3, 3, 70, 17, 16]])
def test_pack_holds_every_token_once_without_padding(lengths):
    check_windows(lengths, packing.pack(lengths, 64, 8), 64)


def test_pack_random_lengths_and_balanced_groups():
    rng = random.Random(4)
    for _ in range(100):
        lengths = [rng.randint(1, rng.choice([5, 60, 400])) for _ in range(rng.randint(0, 80))]
        windows = packing.pack(lengths, 64, 8)
        check_windows(lengths, windows, 64)
        sizes = [s for s, _ in windows]
        groups = packing.step_groups(sizes, 4)
        loads = {g: sum(s for s, x in zip(sizes, groups) if x == g) for g in groups}
        assert not loads or max(loads.values()) - min(loads.values()) <= 64


def test_packed_documents(spark):
    rows = [*enumerate([*ODD, prose(900, 1), "same", "same"]), (None, "no id")]
    got = packing.pack_documents(extra(documents(spark, rows)), PATH, block_ids=3000, with_ids=True).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        own = sorted(by[i], key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == library(t) + [2] and {r.doc_tokens for r in own} == {len(library(t)) + 1}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and {r.sequence_length for r in own} == {at}
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
