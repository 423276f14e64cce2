import random

from pyspark.sql import functions as F

from helpers import ODD, collect, documents, extra, prose
from resalekit.llm import toxicity as t

STEMS = {"grubb": 2.0, "snark": 1.0}


def scores(text):
    return [round(x, 6) for x in t.clauses(text, t.Pieces(STEMS))]


def test_clauses_are_scored_in_context():
    assert scores("a plain text. with clauses; none matches") == []
    assert scores("such grubber here") == [2.0]
    assert scores("you grubber") == [2.5]
    assert scores("this is not a grubber") == [1.0]
    assert scores("he said grubber") == [round(2 * 0.7 * 1.25, 6)]
    assert scores("Grubb! SNARKY, snark. fine") == [2.0, 2.0]
    assert scores("kill. you") == [] and scores("I will kill you") == [0.3] and scores("never kill them") == [0.15]
    assert scores(None) == scores("") == []


def test_composition_reads_like_one_after_the_other():
    a, b = t._near(t.NOT, 2, 0.5), t.Transducer(1, {(0, t.INSULT): (0, t.MATCH, 3.0)})
    c = t.compose(a, b, t.SYMBOLS)
    rng = random.Random(1)
    for _ in range(200):
        word = [rng.choice(t.SYMBOLS) for _ in range(8)]
        x = y = z = 0
        for s in word:
            x, mid, v = a.step(x, s)
            y, out, w = b.step(y, mid)
            z, got, u = c.step(z, s)
            assert (got, u) == (out, v * w) and z == x * b.states + y


def test_stems_are_the_longest_that_hold_the_documents():
    counts = {"gru": (40, 0), "grub": (40, 0), "grubb": (40, 0), "grubba": (15, 0), "grubbo": (14, 1), "the": (60, 400), "rare": (2, 0)}
    assert set(t.learn_stems(counts, 60, 400)) == {"grubb"}


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randint(20, 80), i).split()
        toxic = int(i % 5 == 2)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grubber", "Grubbo,", "snarky", "snarks!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_labels(spark):
    docs, labels = labelled(spark)
    model = t.train(extra(docs), extra(labels), F.col("doc_id") % 4 != 0)
    assert any(s.startswith("grub") for s in model.stems) and any(s.startswith("snar") for s in model.stems)
    got = collect(t.score(docs, model))
    wrong = [r["doc_id"] for r in got if r["doc_id"] % 4 == 0 and (r["score"] >= 0.5) != (r["doc_id"] % 5 == 2)]
    assert len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_no_labels_and_kept_columns(spark):
    docs, labels = labelled(spark, 200)
    model = t.train(docs, labels, F.lit(True))
    odd = documents(spark, [*enumerate(ODD), (None, "grubber grubber grubber snarky"), (0, "again")])
    got = t.score(odd, model, keep=tuple(odd.columns)).collect()
    assert len(got) == len(ODD) + 2 and got[0].asDict().keys() >= set(odd.columns)
    assert all((r.score >= 0.5) == (r.doc_id is None) for r in got)
    for few in (labels.limit(0), labels.filter("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        none = t.train(docs, few, F.lit(True))
        assert none.stems == {} and all(r.score < 0.5 for r in t.score(odd, none).collect())
    assert t.score(odd.limit(0), model).count() == 0
