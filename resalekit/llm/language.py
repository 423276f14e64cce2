"""Language identification by string kernels (operator 5).

The kernel of two texts is the number of character n-grams of 1 to 3 letters
that both have, each counted once (a blended-spectrum presence kernel),
normalised by both texts' numbers of them. Training texts are approximated by
Nystroem features on landmark texts, and a kernel ridge regression for each
language against the rest is solved on them. A batch of texts is scored by
matrix products: presence matrix times the landmarks' presence times the
weights, of which the last two are multiplied once, since they are the same for
all batches."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, stage

#: Slots of the hashed n-grams; texts and landmarks for training at most; words of the short pieces.
BITS, TRAIN_TEXTS, LANDMARKS, PIECE, RIDGE = 17, 3000, 400, 6, 1e-2
#: Training texts of each language at least; weights that are looked up at once.
LEAST_TEXTS, CELLS = 10, 1 << 22
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> itself where it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def presence(text: str) -> np.ndarray:
    """Slots of the distinct n-grams of 1 to 3 characters of a whole text in
    lower case, with runs of other than letters as one blank."""
    a = _folded()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(a), np.uint32)
    for n in range(1, 4):
        h = (h[:len(a) - n + 1] + a[n - 1:]) * np.uint32(0x9E3779B1) + np.uint32(n)
        seen[(h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def learned(text: str) -> list[np.ndarray]:
    """What a training text gives: itself and a short piece of it, so that short texts are learned too."""
    words = text.split()
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(words) - PIECE + 1)
    return [presence(x) for x in dict.fromkeys((text, " ".join(words[at:at + PIECE]))) if LETTER.search(x)]


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the weight of every slot for each, of presence vectors and their languages. Each
    language has a landmark at least."""
    names = sorted(set(langs))
    if not rows:
        return [], np.zeros((1 << BITS, 0), np.float32)
    place = {lang: c for c, lang in enumerate(names)}
    y = [place[lang] for lang in langs]
    y = np.array(y)
    root = np.sqrt([len(r) for r in rows])
    # landmarks: as many of each language, spread over the rows
    order = np.concatenate([np.flatnonzero(y == c)[:: max(1, int((y == c).sum() * len(names) / landmarks))] for c in range(len(names))])
    marks = np.zeros((len(order), 1 << BITS), bool)
    for j, i in enumerate(order):
        marks[j, rows[i]] = True
    k = np.stack([marks[:, r].sum(1) for r in rows]) / root[:, None] / root[order]
    values, vectors = np.linalg.eigh(k[order])
    keep = values > values.max() * 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ half
    share = np.bincount(y, minlength=len(names))[y]
    weight = (len(y) / len(names) / share)[:, None]  # languages count alike
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    a = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return names, (marks.T.astype(np.float32) @ (half @ a / root[order, None]).astype(np.float32))


def sample(docs: DataFrame, training: Column, most: int = TRAIN_TEXTS, least: int = LEAST_TEXTS) -> DataFrame:
    """About ``most`` labelled rows that may be learned from, as many of each
    language as there are, picked by a hash of doc_id. Where that would be fewer than ``least`` of each
    language, ``least`` of each: no language is left out, however many there are."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs = each.count()
    quota = max(most / max(1, langs), least)
    share = each.select(F.col("lang").alias("of_lang"), F.least(F.lit(1.0), F.lit(quota) / F.col("n")).alias("share"))
    lot = (F.xxhash64(F.lit(5), "doc_id").bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    return rows.join(broadcast_if_small(share), F.col("lang") == F.col("of_lang")).filter(lot < F.col("share")).limit(int(2 * quota * langs))


def _vectors(rows: DataFrame) -> tuple[list[np.ndarray], list[str]]:
    """Presence vectors of the sampled rows and their languages, in one order. They are made in the
    tasks; a text of any length is 2^17 slots at most here."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for doc, lang, text in zip(*(part.column(c).to_pylist() for c in ("doc", "lang", "text"))):
                    own = [(doc, lang, v) for v in learned(text)]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.string()),
                                                          pa.array([o[2].astype(np.int32).tobytes() for o in own], pa.binary())], ["doc", "lang", "slots"])

    made = rows.select(F.col("doc_id").cast("string").alias("doc"), "lang", "text").mapInArrow(run, "doc string, lang string, slots binary")
    got = sorted((r["doc"] or "", r["lang"], bytes(r["slots"])) for r in made.toPandas().to_dict("records"))
    return [np.frombuffer(r[2], np.int32) for r in got], [r[1] for r in got]


def scores(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The regressions' values for presence vectors, ``CELLS`` weights at a time."""
    n = np.array([len(r) for r in rows])
    flat, ends = np.concatenate(rows), np.cumsum(n)
    out, step = np.zeros((len(rows), weights.shape[1])), max(1, CELLS // weights.shape[1])
    for a in range(0, len(flat), step):
        b = min(a + step, len(flat))
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        starts = np.maximum((ends - n)[first:last + 1], a) - a
        out[first:last + 1] += np.add.reduceat(weights[flat[a:b]], starts, axis=0)
    return out / np.sqrt(n)[:, None]


def identify(docs: DataFrame, training: Column, most: int = TRAIN_TEXTS) -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score (softmax of the
    languages' regressions). ``training`` marks the rows that may be learned from.

    Null text or no letter, or nothing to learn from: ``und`` with score 0. The
    model is fitted on the presence vectors of about ``most`` rows, or of ``LEAST_TEXTS`` of each language if that is more
    (the driver's memory is bounded by them), and takes half a MB a language;
    every whole text is scored in one pass without a shuffle. Null or
    repeated doc_id: each row is scored by its text. Other columns are not read."""
    names, weights = fit(*_vectors(sample(docs, training, most)))
    model = docs.sparkSession.sparkContext.broadcast((names, weights))

    def run(batches):
        names, weights = model.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if t and names and LETTER.search(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    f = scores(weights, [presence(texts[i]) for i in known])
                    p = np.exp(4 * (f - f.max(1, keepdims=True)))
                    score[known] = 1 / p.sum(1)
                    for i, best in zip(known, f.argmax(1)):
                        lang[i] = names[best]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")
