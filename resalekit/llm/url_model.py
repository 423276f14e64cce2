"""URL filter by a character language-model ratio (operator 7), DataFrame
functions only.

Rules decide the urls they fit and label the training rows: urls that a rule
allows train one smoothed variable-order Markov model, urls that a rule blocks
the other. Witten-Bell smoothing interpolates the orders 0 to ``order``::

    p_k(c | x) = (n(xc) + t(x) p_(k-1)(c | x')) / (n(x) + t(x)),  p_-1 = 1 / ALPHABET

with n the count, t the kinds of characters after context x, and x' without its
first character. A url's score is the mean over its characters and its end of
ln p_allowed - ln p_blocked; the threshold lies between the means of both
classes, as many standard deviations from either."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage

ORDER, ALPHABET = 4, 256
START, END = "\x02", "\x03"
#: (verdict, host, start of the path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER = "".join(map(chr, range(65, 91)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), empty), F.coalesce(path, empty)


def fitting_rule(host: Column, path: Column, rules=None) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules or RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of ``url`` and its end: the ``order`` characters before it and itself."""
    padded = F.concat(F.lit(START * order), "url", F.lit(END))
    at = F.sequence(F.lit(1), F.char_length("url") + 1)
    return urls.select("*", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(order + 1)))).alias("gram"))


def _suffixes(order: int) -> Column:
    """struct(k, suffix) for the orders: the last k + 1 characters of ``gram``."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.substring("gram", order + 1 - k, k + 1).alias("suffix"))
                     for k in range(order + 1)])


def model(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """ln p_allowed - ln p_blocked of each distinct gram of ``urls`` (url,
    allowed, blocked: its training counts). Counts cover all rows. They are
    partially aggregated before each shuffle; every join has distinct
    grams on one side at least."""
    grams = stage(_grams(urls, order).groupBy("gram").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")), "url-grams")
    each = grams.select("gram", "a", "b", F.inline(_suffixes(order)))
    counts = stage(each.groupBy("k", "suffix").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-counts")
    head = F.expr("substring(suffix, 1, k)")
    contexts = counts.groupBy("k", head.alias("x")).agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.signum("a")).alias("ta"), F.sum(F.signum("b")).alias("tb"))
    known = counts.withColumn("x", head).join(contexts, ["k", "x"]).drop("x")
    steps = each.drop("a", "b").join(known, ["k", "suffix"]).groupBy("gram").agg(
        F.sort_array(F.collect_list(F.struct("k", "a", "na", "ta", "b", "nb", "tb"))).alias("s"))  # order + 1 of them

    def log_p(c, n, t):
        return F.log(F.aggregate("s", F.lit(1.0 / ALPHABET), lambda p, s: F.when(
            s[n] > 0, (s[c] + s[t] * p) / (s[n] + s[t])).otherwise(p)))

    return steps.select("gram", (log_p("a", "na", "ta") - log_p("b", "nb", "tb")).alias("ratio"))


def score_urls(pages: DataFrame, rules=None, order: int = ORDER) -> DataFrame:
    """A row per page: page_id, url, host, path, rule, verdict, score, threshold.

    ``verdict`` is the rule's, else ``allow`` if score >= threshold, else
    ``block``. Each distinct url is scored once, so pages with one url cost
    nothing more. Null url: scored as the empty text, host and path
    empty. If no url trains one of the models, urls without a rule are
    allowed and threshold is null. Other columns are not read; no rows: no rows."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    label = lambda v: F.sum((F.col("r.verdict") == v).cast("long"))
    urls = rows.groupBy(F.col("u").alias("url")).agg(
        F.coalesce(label("allow"), F.lit(0)).alias("allowed"), F.coalesce(label("block"), F.lit(0)).alias("blocked"))
    urls = stage(urls, "urls")
    ratios = stage(model(urls, order), "url-model")
    scored = _grams(urls, order).join(broadcast_if_small(ratios), "gram")
    scored = stage(scored.groupBy("url", "allowed", "blocked").agg(F.avg("ratio").alias("score")), "url-scores")
    stat = lambda f, c: f(F.when(F.col(c) > 0, F.col("score")))
    m = scored.agg(*[stat(f, c).alias(n + c) for c in ("allowed", "blocked") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    limit = None
    if m["mallowed"] is not None and m["mblocked"] is not None:
        a, b = max(m["sallowed"], 1e-9), max(m["sblocked"], 1e-9)
        limit = (m["mallowed"] * b + m["mblocked"] * a) / (a + b)
    out = rows.join(scored.select(F.col("url").alias("u"), "score"), "u", "left")
    threshold = F.lit(limit).cast("double")
    verdict = F.coalesce("r.verdict", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score",
                      threshold.alias("threshold"))
