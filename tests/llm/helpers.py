"""Rows with every odd case, and plain Python versions of the shared definitions."""

import random
import re
import zlib

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def documents(spark, texts):
    """(doc_id, text) rows, or texts numbered from 0, as a table of documents."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "Ünïcode ÀÉ ß 漢字", "x" * 5000, "a b", "\x1c\x85\xa0 z", prose(20000, 99)]


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def collect(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0, str(r)))


def extra(df):
    """The same rows with more columns, named like ones that operators use."""
    from pyspark.sql import functions as F
    names = ["key", "n", "sid", "token", "words", "hits", "v", "score", "n_words", "n_hit", "at", "row", "label", "component_id", "host", "kept"]
    return df.select("*", *[F.lit(1).alias(c) for c in names if c not in df.columns])
