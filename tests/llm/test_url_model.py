import math
import re
from collections import Counter

import pytest

from helpers import LOWER, extra
from resalekit.llm import url_model

URLS = ["http://a.example.net/en/1", "https://A.Example.NET/de/2", "http://x.example.com/de/3?u=http://y/", "http://example.com/fr/9",
        "http://z.org/fr/4", "http://z.org/en/4#/fr/", "http://net/", "http://net", "http://notnet/en/", None, "", "no scheme", "://",
        "http://q.example.org?x=/fr/", "http://h/a\nb", "http://example.net/en/", "https://m.example.com/en/7"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(urls, order):
    """Scores and threshold by plain counting."""
    label = [rule(*parts(u))[1] for u in urls]
    kinds = [Counter(), Counter()]
    for u, v in zip(urls, label):
        if v:
            s = url_model.START * order + (u or "") + url_model.END
            for i in range(order, len(s)):
                for k in range(order + 1):
                    kinds[v == "block"][s[i - k:i + 1]] += 1
    totals = []
    for c in kinds:
        n, t = Counter(), Counter()
        for g, x in c.items():
            n[g[:-1]] += x
            t[g[:-1]] += 1
        totals.append((c, n, t))

    def log_p(model, gram):
        c, n, t = totals[model]
        p = 1 / url_model.ALPHABET
        for k in range(order + 1):
            g = gram[order - k:]
            if n[g[:-1]]:
                p = (c[g] + t[g[:-1]] * p) / (n[g[:-1]] + t[g[:-1]])
        return math.log(p)

    score = {}
    for u in {u or "" for u in urls}:
        s = url_model.START * order + u + url_model.END
        grams = [s[i - order:i + 1] for i in range(order, len(s))]
        score[u] = sum(log_p(0, g) - log_p(1, g) for g in grams) / len(grams)
    stats = []
    for v in ("allow", "block"):
        x = [score[u] for u in {u or "" for u, w in zip(urls, label) if w == v}]
        m = sum(x) / len(x)
        stats.append((m, max(1e-9, math.sqrt(sum((y - m) ** 2 for y in x) / len(x)))))
    (ma, a), (mb, b) = stats
    return score, (ma * b + mb * a) / (a + b)


@pytest.mark.parametrize("order", [1, 4])
def test_equals_brute_force(spark, order):
    urls = URLS + [f"http://h{i % 7}.example.{t}/{lang}/{i}" for i, (t, lang) in enumerate(
        (t, lang) for t in ("net", "com", "org") for lang in ("en", "de", "fr") for _ in range(3))] + URLS[:3] * 5
    score, limit = brute(urls, order)
    got = url_model.score_urls(extra(pages(spark, urls)), order=order).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        name, verdict = rule(host, path)
        assert r.rule == name and abs(r.score - score[r.url or ""]) < 1e-9 and abs(r.threshold - limit) < 1e-9
        assert r.verdict == (verdict or ("block" if r.score < limit - 1e-12 else "allow"))


def test_nothing_to_learn_and_no_rows(spark):
    got = url_model.score_urls(pages(spark, ["http://x.com/", None, "http://y.net/"])).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "allow", 1: "allow", 2: "block"} and got[0].threshold is None
    assert url_model.score_urls(pages(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = url_model.score_urls(pages(spark, URLS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
