import functools
import random
import re
import time
from collections import Counter

from helpers import ODD, WORDS, collect, documents, extra
from resalekit.llm import quality_ledger as q


def brute(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    pos = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(pos)}


TEXTS = [*ODD, "a a a a", "a a a", "#$ <b>\n#$ <b>\n\n \n#$ <b>\r", "a b c x a b c", "\x1cq\x85 \xa0"]


def many():
    rng = random.Random(5)
    return ["".join(rng.choice("ab  c\n#\t") for _ in range(rng.randint(0, 200))) for _ in range(150)]


def test_measurements_equal_brute_force(spark):
    texts = TEXTS + many()
    rows = [*enumerate(texts), (None, "a b"), (3, "again"), (3, "again")]
    got = q.measure(extra(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = Counter((i, tuple(brute(t).items())) for i, t in rows)
    assert Counter((r.doc_id, tuple((m, r[m]) for m in brute(""))) for r in got) == want


def test_windows_that_agree_in_the_packed_bits_only(spark, monkeypatch):
    """With most bits of a hash cut off, different windows fall together and are told apart."""
    texts = many() + ["a b c d e f g h i j a b c", "a b c d e f g h"]
    df = documents(spark, texts)
    monkeypatch.setattr(q, "_repeats", functools.partial(q._repeats, bits="61"))
    got = collect(q.measure(df))
    assert [r["n_repeat_words"] for r in got] == [brute(t)["n_repeat_words"] for t in texts]


def test_a_text_of_two_million_words(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(200)}" for _ in range(1_990_000)] + ["so", "on"] * 5000
    text = " ".join(words)
    began = time.time()
    got = q.measure(documents(spark, [text])).first()
    assert time.time() - began < 60
    assert {m: got[m] for m in brute("")} == brute(text)


def test_ledger_policies_and_ablation(spark):
    texts = TEXTS + many() + [" ".join(f"w{i}" for i in range(80)), " ".join(["x y z"] * 40), "# " * 90]
    rows = collect(q.ledger(documents(spark, texts)))
    for r, t in zip(rows, texts):
        for rule in q.RULES:
            fails = bool(eval(re.sub(r"(?<![<>])=(?!=)", "==", rule.fails), {}, brute(t)))
            assert bool(r["failed"] >> rule.bit & 1) == fails, (rule, r)
    df = q.ledger(documents(spark, texts))
    for name in q.POLICIES:
        mask = q.mask(name)
        assert [r["kept"] for r in collect(q.apply_policy(df, name))] == [r["failed"] & mask == 0 for r in rows]
        got = {r.rule: r for r in q.ablation(df, name).collect()}
        assert set(got) == set(q.POLICIES[name])
        for rule in q.RULES:
            if rule.name in got:
                bit = 1 << rule.bit
                assert got[rule.name].n_failed == sum(bool(r["failed"] & bit) for r in rows)
                assert got[rule.name].n_only == sum(r["failed"] & mask == bit for r in rows)
                assert got[rule.name].n_kept_without == sum(r["failed"] & mask & ~bit == 0 for r in rows)


def test_empty_table_and_no_python(spark):
    df = q.ledger(documents(spark, []))
    assert df.count() == 0 and {(r.n_failed, r.n_only) for r in q.ablation(df, "web-1").collect()} == {(0, 0)}
    plan = q.ledger(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
