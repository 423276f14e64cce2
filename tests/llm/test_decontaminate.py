import random
import re

import pytest

from helpers import LOWER, ODD, collect, documents, extra
from resalekit.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, span):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(LOWER))
        n = min(span, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else ()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.update([] if item is None else [str(item)])
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("span,gram", [(13, 5), (4, 2), (3, 5)])
def test_equals_brute_force(spark, span, gram):
    rng = random.Random(span)
    word = lambda: rng.choice("a b c d e É 1".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 13, 20])))) for i in range(12)]
    items += [(50, None), (51, "!!"), (52, items[11][1]), (None, "q q q")]
    docs = list(enumerate([*ODD, *(" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(20))]))
    docs += [(len(docs) + i, f"intro {t.upper()}, outro") for i, (_, t) in enumerate(items) if t]
    docs += [(1, "a b c d"), (None, items[9][1]), (None, "nothing here"), docs[12]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(extra(documents(spark, docs)), extra(bench), span, gram, keep=("doc_id", "text")).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute(r.text, items, span)
        assert (r.n_words, r.n_hit, list(r.item_ids)) == (n, hit, found), r
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], r["n_hit"]) for r in collect(contamination(documents(spark, ["a b", None]), bench))] == [(2, 0), (0, 0)]
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert contamination(documents(spark, []), bench).count() == 0


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = contamination(documents(spark, ["a b c d"]), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
