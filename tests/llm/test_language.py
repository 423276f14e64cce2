import random

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, collect, documents, extra
from resalekit.llm import language

SYLLABLES = {"aa": "ka ro ti mu sen".split(), "bb": "schu ber ung ein lich".split(), "cc": "ção não ela ique ñu".split()}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    return documents(spark, [(i, t) for i, t, _ in rows]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, _, lang in rows], "doc_id bigint, lang string"), "doc_id")


def test_presence_is_the_set_of_grams():
    a, b = set(language.presence("Ab, ab!")), set(language.presence("ab ab"))
    assert a == b and set(language.presence("ab")) < b | set(language.presence(" ab "))
    # characters " ab ab ": 3 single, " a" "ab" "b ", " ab" "ab " "b a"
    assert len(b) == 9


def test_scores_are_kernel_products():
    """The weights give the same as kernels with the landmarks, Nystroem features and ridge regression, from sets of slots."""
    texts = [text(lang, 30, i) for lang in SYLLABLES for i in range(6)]
    langs = [lang for lang in SYLLABLES for _ in range(6)]
    rows = [language.presence(t) for t in texts]
    names, w = language.fit(rows, langs, landmarks=1000, ridge=0.05)
    assert names == sorted(SYLLABLES)
    kernel = lambda a, b: len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in rows] for a in rows])
    values, vectors = np.linalg.eigh(k)
    phi = k @ vectors / np.sqrt(values)
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    a = np.linalg.solve(phi.T @ phi + 0.05 * len(rows) / 100 * np.eye(len(rows)), phi.T @ target)  # as many rows of each
    asked = [language.presence(text(lang, n, 77)) for lang in SYLLABLES for n in (1, 8, 300)]
    want = np.array([[kernel(x, r) for r in rows] for x in asked]) @ vectors / np.sqrt(values) @ a
    assert np.abs(language.scores(w, asked) - want).max() < 1e-4
    assert [names[c] for c in want.argmax(1)] == [lang for lang in SYLLABLES for _ in range(3)]


def test_blocks_of_weights_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(1 << language.BITS, 3))
    rows = [np.sort(rng.choice(1 << language.BITS, n, replace=False)) for n in (1, 5, 400, 2, 90)]
    whole = language.scores(w, rows)
    monkeypatch.setattr(language, "CELLS", 21)
    assert np.allclose(language.scores(w, rows), whole) and np.allclose(whole, [w[r].sum(0) / len(r) ** 0.5 for r in rows])


def test_every_language_is_learned(spark):
    """More languages than the texts that are asked for; each has its own letters."""
    own = {f"l{c:03d}": [chr(0x4E00 + 40 * c + i) for i in range(40)] for c in range(350)}
    say = lambda lang, seed: " ".join("".join(random.Random(f"{lang}{seed}{i}").choices(own[lang], k=3)) for i in range(12))
    rows = [(1000 * s + c, say(lang, s), lang) for c, lang in enumerate(own) for s in range(3)]
    got = {r["doc_id"]: r["lang_pred"] for r in collect(language.identify(table(spark, rows), F.col("doc_id") < 2000, most=100))}
    assert sum(got[i] == lang for i, _, lang in rows if i >= 2000) >= 0.95 * len(own)
    assert len({got[i] for i, _, _ in rows}) >= 0.95 * len(own)


def test_held_out_texts(spark):
    rows = [(i, text(lang, random.Random(i).choice([2, 5, 40, 200]), i), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    got = collect(language.identify(extra(table(spark, rows)), F.floor(F.col("doc_id") / 3) % 3 != 1))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["lang_pred"], lang) for r, (i, _, lang) in zip(got, rows) if i // 3 % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_odd_texts_and_nothing_to_learn(spark):
    rows = [(i, t, "aa") for i, t in enumerate(ODD)] + [(100 + i, text(lang, 20, i), lang) for i, lang in enumerate(SYLLABLES)] + [(200, "1 2 3 ²", None)]
    got = {r["doc_id"]: r for r in collect(language.identify(table(spark, rows), F.lit(True)))}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 200)] == ["und"] * 4 and got[0]["score"] == 0
    assert all(got[i]["lang_pred"] in SYLLABLES for i in (3, 4, 5, 101))
    none = collect(language.identify(table(spark, rows), F.lit(False)))
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.identify(documents(spark, []), F.lit(True)).count() == 0
