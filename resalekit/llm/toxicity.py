"""Toxicity by a weighted finite-state pattern grammar (operator 10).

Words are mapped to symbols: INSULT (word stems learned from labelled rows),
THREAT, TARGET, NOT and SAID (fixed lists of common words), WORD. Five small weighted
transducers read the symbols of a clause; their composition is one transducer
whose path weight is the clause's score. Documents are scored by a logistic
function of their matched clauses, whose weights are learned too, so that a
word alone decides nothing: what counts is the clause it stands in."""

from __future__ import annotations

import functools
import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, stage

WORD, INSULT, THREAT, TARGET, NOT, SAID, MATCH = "WORD", "INSULT", "THREAT", "TARGET", "NOT", "SAID", "MATCH"
#: Labelled rows to learn from at most; stems kept at most; stem lengths.
TRAIN_ROWS, STEMS, LENGTHS = 10_000, 2000, (3, 12)
CACHE_PIECES = 200_000
#: The highest score without a matched clause.
NO_MATCH = 0.49

# Common words of the languages served.
THREATS = "kill hurt destroy punish attack beat töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she him they them du dich dir ihr euch sie tu toi te vous ils elle tú usted ustedes ellos él".split()
NEGATIONS = "not no never without neither nor nicht kein keine nie ohne pas jamais sans nunca sin tampoco".split()
REPORTS = "said says say wrote writes quoted reported claims sagte sagt schrieb dit écrit déclaré dijo dice escribió".split()

WORDS = regex.compile(r"\p{L}+")
CLAUSE_END = regex.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (state, symbol out, weight). A missing arc keeps
    the symbol, at weight 1, and goes where ``rest`` leads, else stays. Starts in 0."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str, float]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


def compose(a: Transducer, b: Transducer, symbols: Iterable[str]) -> Transducer:
    """Reads as ``a``, whose output ``b`` reads; weights multiply."""
    arcs = {}
    for i in range(a.states):
        for j in range(b.states):
            for s in symbols:
                x, mid, v = a.step(i, s)
                y, out, w = b.step(j, mid)
                arcs[i * b.states + j, s] = (x * b.states + y, out, v * w)
    return Transducer(a.states * b.states, arcs)


def _near(trigger: str, reach: int, factor: float, symbol: str = INSULT) -> Transducer:
    """``symbol`` weighs ``factor`` within ``reach`` words after ``trigger``."""
    arcs = {(s, trigger): (reach, trigger, 1.0) for s in range(reach + 1)}
    arcs |= {(s, symbol): (s - 1, symbol, factor) for s in range(1, reach + 1)}
    return Transducer(reach + 1, arcs, {s: s - 1 for s in range(1, reach + 1)})


SYMBOLS = (WORD, INSULT, THREAT, TARGET, NOT, SAID)


@functools.lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Reported speech, negation, target, threat, insult, composed in this order."""
    said = Transducer(2, {(0, SAID): (1, SAID, 1.0), (1, INSULT): (1, INSULT, 0.7), (1, THREAT): (1, THREAT, 0.7)})
    threat = Transducer(4, {**{(s, THREAT): (3, THREAT, 1.0) for s in range(4)},
                            **{(s, TARGET): (0, MATCH, 0.3) for s in range(1, 4)}}, {1: 0, 2: 1, 3: 2})
    insult = Transducer(1, {(0, INSULT): (0, MATCH, 1.0)})
    parts = [said, _near(NOT, 3, 0.5), _near(NOT, 3, 0.5, THREAT), _near(TARGET, 6, 1.25), threat, insult]
    return functools.reduce(lambda a, b: compose(a, b, (*SYMBOLS, MATCH)), parts)


@dataclass(frozen=True)
class Model:
    """What is learned: stem -> weight, and the logistic's weights."""

    stems: dict[str, float]
    logistic: tuple[float, ...]


class Pieces(dict):
    """Blank-free piece of text -> (symbol, weight) of its words, None standing
    for a clause end. ``hits``: the pieces seen that have an insult or a threat."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems, self.hits, self.same = stems, set(), {}
        self.fixed = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NOT, NEGATIONS), (SAID, REPORTS)) for w in words}

    def stem(self, word: str) -> float:
        return max((self.stems[word[:n]] for n in range(LENGTHS[0], min(len(word), LENGTHS[1]) + 1) if word[:n] in self.stems), default=0.0)

    def __missing__(self, piece: str) -> tuple:
        out, at = [], 0
        low = piece.lower()
        for m in WORDS.finditer(low):
            out += [None] * bool(CLAUSE_END.search(low, at, m.start()))
            weight = self.stem(m.group())
            out.append((INSULT, weight) if weight else (self.fixed.get(m.group(), WORD), 0.0))
            at = m.end()
        out += [None] * bool(CLAUSE_END.search(low, at))
        if any(x and x[0] in (INSULT, THREAT) for x in out):
            self.hits.add(piece)
        symbols = tuple(out)
        if len(self) < CACHE_PIECES:
            symbols = self[piece] = self.same.setdefault(symbols, symbols)  # nearly all pieces have the same few
        return symbols


def clauses(text: str | None, pieces: Pieces) -> Iterator[float]:
    """Scores of the clauses that match. A text without insult and threat
    is not read further than its words."""
    words = (text or "").split()
    deque(map(pieces.__getitem__, words), maxlen=0)
    if pieces.hits.isdisjoint(words):
        return
    fst, end = grammar(), (None,)
    read = [s for line in text.split("\n") for s in (*map(pieces.__getitem__, line.split()), end)]
    state, score, weight = 0, 0.0, 1.0
    for s in read:
        for x in s:
            if x is None:
                if score:
                    yield score
                state, score = 0, 0.0
                continue
            state, out, w = fst.step(state, x[0])
            weight = w if x[0] == THREAT else weight  # a threat matches at its target
            if out == MATCH:
                score += w * (x[1] or weight)


def features(text: str | None, pieces: Pieces) -> tuple[float, float, float]:
    """Matched clauses, their summed and their best score, on a log scale."""
    found = list(clauses(text, pieces))
    return math.log1p(len(found)), math.log1p(sum(found)), math.log1p(max(found, default=0.0))


def support(toxic: int, clean: int) -> float:
    """Toxic documents that a stem needs: 3, 1 % of them, and so many that they
    are toxic by chance in one of 100,000 cases only."""
    return max(3.0, 0.01 * toxic, math.log(1e-5) / math.log(toxic / (toxic + clean)))


def learn_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems from counts of toxic and clean documents. A stem is in at least
    ``support`` toxic documents and at most a fiftieth as often, in proportion,
    in clean ones. Where one longer stem makes nearly all of a stem's documents,
    the longer one is taken."""
    least = support(toxic, clean)
    good = {p: t for p, (t, c) in counts.items() if t >= least and c * toxic * 50 <= t * clean}
    longer: dict[str, int] = {}
    for p, t in good.items():
        longer[p[:-1]] = max(longer.get(p[:-1], 0), t)
    ends = [p for p, t in good.items() if longer.get(p, 0) < 0.9 * t]
    # of a stem and its own beginnings the shortest is enough
    held = set(ends)
    chosen = [p for p in ends if not any(p[:n] in held for n in range(LENGTHS[0], len(p)))]
    weight = {p: math.log((counts[p][0] + 0.5) / (toxic + 1)) - math.log((counts[p][1] + 0.5) / (clean + 1)) for p in chosen}
    return dict(sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:STEMS])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method, with a small penalty on all weights but the last, the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), ridge * np.array([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty)
        b = b - np.linalg.solve(h, x.T @ (p - y) / len(x) + penalty * b)
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, training: Column, most: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``most`` labelled rows that ``training`` marks, picked by a hash of doc_id.

    Labels that are null are not used. Without toxic or without clean rows the
    model has no stems and scores every text 0."""
    ids = labels.filter(training & F.col("toxic").isin(0, 1)).select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(most).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")  # ``most`` ids
    rows = stage(rows, "labelled-texts")

    def prefixes(text):
        words = set(WORDS.findall((text or "").lower()))
        return {w[:n] for w in words for n in range(LENGTHS[0], min(len(w), LENGTHS[1]) + 1)}

    def count(wanted):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    found = Counter()
                    for t in part.column("text").to_pylist():
                        p = prefixes(t)
                        found.update(p if wanted is None else p & wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["p", "n"])

        return run

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, ())
    least = support(toxic, clean)
    seen = rows.filter("toxic = 1").select("text").mapInArrow(count(None), "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    bad = {r["p"]: r["n"] for r in seen.filter(F.col("n") >= least).toLocalIterator()}  # of ``most`` rows
    wanted = set(bad)
    good = rows.filter("toxic = 0").select("text").mapInArrow(count(wanted), "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    fine = {r["p"]: r["n"] for r in good.toLocalIterator()}
    stems = learn_stems({p: (n, fine.get(p, 0)) for p, n in bad.items()}, toxic, clean)

    def measure(batches):
        pieces = Pieces(stems)
        for batch in batches:
            for part in slices(batch):
                f = [features(t, pieces) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*f)), part.column("toxic")], ["a", "b", "c", "toxic"])

    x = np.array([tuple(r) for r in rows.mapInArrow(measure, "a double, b double, c double, toxic int").toLocalIterator()])
    return Model(stems, fit_logistic(x[:, :3], x[:, 3]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of ``docs``: its columns ``keep``, doc_id, score (0 to 1) and
    n_clauses, the clauses that match.

    One pass over whole texts, no shuffle. A text that matches nothing, as null
    and empty ones, has the constant's score, ``NO_MATCH`` at most. Null or repeated doc_id: each row by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    cols = ["doc_id", *[c for c in keep if c != "doc_id"]]

    def run(batches):
        m = shared.value
        pieces = Pieces(m.stems)
        for batch in batches:
            for part in slices(batch):
                f = np.array([features(t, pieces) for t in part.column("text").to_pylist()]).reshape(-1, 3)
                b = np.array(m.logistic or (0.0, 0.0, 0.0, -30.0))
                p = 1 / (1 + np.exp(-np.clip(f @ b[:3] + b[3], -30, 30)))
                p = np.where(f[:, 0] > 0, p, np.minimum(p, NO_MATCH))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in cols], pa.array(p), pa.array(np.rint(np.expm1(f[:, 0])).astype(np.int64))],
                                                 [*cols, "score", "n_clauses"])
        pieces.clear()
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double, n_clauses bigint")
