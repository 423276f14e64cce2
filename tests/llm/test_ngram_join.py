import random

import pytest

from helpers import LOWER, ODD, WORDS, collect, documents, extra, prose
from resalekit.llm import ngram_join
from resalekit.llm.ngram_join import join_components, one_of_each


def shingle_set(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    out = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            ids = [d for j, (d, _) in enumerate(rows) if sets[j] and find(j) == find(i) and d is not None]
            out.setdefault(doc, set()).add((len(sets[i]), min(ids, default=None)))
        else:
            out.setdefault(doc, set()).add((0, doc))
    return out


def family(seed, n, size, edits):
    """Near copies of one text, from none to ``edits`` words changed in each: many are linked only through others."""
    rng = random.Random(seed)
    base = prose(size, seed).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    shared = prose(60, 5)  # a passage that many texts have
    texts = [*ODD, "ONE", "a b", *family(1, 60, 120, 9), *family(2, 25, 300, 12),
             *(f"{prose(40, 100 + i)} {shared} {prose(20, 300 + i)}" for i in range(40)), prose(80, 7), prose(80, 7).upper()]
    rng = random.Random(3)
    rng.shuffle(texts)
    rows = [*enumerate(texts), (None, prose(80, 7)), (None, "alone with no id"), (3, texts[3]), (4, prose(50, 8))]
    want = brute(rows, k, percent)
    got = collect(join_components(extra(documents(spark, rows)), k, percent))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) in want[r["doc_id"]], r


def test_repeated_rows_count_once(spark):
    rows = []
    for i in range(12):
        a = prose(403, 900 + i, 10**6).split()
        b = list(a)
        for j in range(9):
            b[20 + 40 * j] = f"e{i}x{j}"
        rows += [(2 * i, " ".join(a))] * 2 + [(None if i % 2 else 2 * i + 1, " ".join(b))] * (1 + i % 2)
    want = brute(rows, 4, 85)
    for r in collect(join_components(documents(spark, rows))):
        assert (r["n_shingles"], r["component_id"]) in want[r["doc_id"]], r


def test_one_of_each(spark):
    rows = [(5, prose(50, 1)), (2, prose(50, 1)), (2, prose(50, 1)), (9, prose(50, 2)), (None, prose(50, 2)), (3, ""), (4, None), (3, "")]
    docs = documents(spark, rows)
    got = one_of_each(docs, join_components(docs, 5, 80))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 3, 4, 9]


def test_empty_table(spark):
    docs = documents(spark, [])
    joined = join_components(docs)
    assert joined.count() == 0 and one_of_each(docs, joined).count() == 0


def test_pages_of_one_template_do_not_all_meet(spark, monkeypatch):
    """Pages that share 100 words and have 10 of their own do not link, but for a few near copies."""
    rng, common = random.Random(3), prose(100, 1, 10**6)
    texts = [f"{common} {prose(10, 100 + i, 10**6)}" for i in range(150)]
    for i in range(30):
        words = texts[i].split()
        words[rng.choice([0, 60, 109])] = f"e{i}"
        texts.append(" ".join(words))
    met, pairs_of = [], ngram_join.mixed_pairs

    def counted(*args):
        met.append(pairs_of(*args))
        return met[-1]

    monkeypatch.setattr(ngram_join, "mixed_pairs", counted)
    got = collect(join_components(documents(spark, texts)))
    assert met[0].count() < 20 * len(texts)  # of some 16,000 pairs, each in several buckets
    want = brute(list(enumerate(texts)), 4, 85)
    assert all({(r["n_shingles"], r["component_id"])} == want[r["doc_id"]] for r in got) and len(got) == len(want)
    assert len({r["component_id"] for r in got}) < len(got)


def test_tables_of_finished_steps_are_gone(spark):
    import os

    from resalekit.session import shared_root

    def tables():
        return set(os.listdir(shared_root(spark).removeprefix("file:")))

    rows = documents(spark, [*ODD, *family(5, 80, 12, 4), *family(6, 60, 8, 3)])
    before = tables()
    joined = join_components(rows)
    left = {t.rsplit("-", 1)[0] for t in tables() - before}
    assert left == {"set-rows", "set-labels", "component-ids", "mixed-buckets"}
    assert joined.count() == rows.count()
