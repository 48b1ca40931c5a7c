"""Toxicity by weak supervision (operator 7).

From a bounded sample of labelled rows (SAMPLE of them at most, by hash of their id; none of the held-out fold), words and
word beginnings that stand out in toxic texts are mined and dealt to LEXICONS lexicons. Each lexicon votes where its
words make up more than a share of a text's words; the share of all of them, the number of different ones, a public list
of insults and patterns (shouting, masked words, runs of punctuation) are further voters. The annotations themselves do not vote: a generative
label model, fitted by expectation maximisation from the voters alone, estimates each voter's rate in either class;
correlations of voters within the classes discount voters that say the same. A logistic regression on the mined
features, patterns and shares is trained on the resulting posterior labels and scores every text in one pass over the
documents.

Scores come from the text alone. A null or empty text has no features and gets the score of the intercept; a very long
text is read whole. Without any usable label, or with one class only, every score is the share of toxic labels (0 if there
are none). Repeated rows score alike; of documents that repeat an id one is learned from; labels that repeat an id count
once (toxic if any says so); rows with a null id are never learned from and are not held out. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, ship, table

#: The bound on labelled rows that the classifier is fitted on.
SAMPLE = 12_000
FOLDS = 5
PREFIXES = (3, 4, 5, 6)
#: The strongest mined features that are kept; as many are weighted at most.
MAX_FEATURES = 600
#: How many times more frequent a feature must be in toxic texts.
LIFT = 5
LEXICONS = 6
#: Shares of a text's words, one lexicon's and all lexicons', from which there is a vote; a text counts as FEW_WORDS at least.
SHARES_ONE = (0.003, 0.01)
SHARES_ALL = (0.01, 0.02, 0.03, 0.04)
#: Numbers of different mined features from which there is a vote; with fewer than the first the share of all counts as none.
DIFFERENT = (2, 4, 6)
#: The voter (of SHARES_ALL) that the label model starts from.
START = 1
FEW_WORDS = 20
RIDGE = 1.0
CACHED_WORDS = 120_000
BATCH_TEXTS = 1_000
#: Common insults of four languages.
INSULTS = """
idiot moron imbecile stupid dumb loser scum trash garbage filth vermin clown jerk pathetic worthless useless disgusting liar bastard
imbécile stupide connard salaud ordure crétin abruti minable pathétique débile pourriture
trottel dummkopf abschaum arschloch versager schwachkopf erbärmlich wertlos dreck widerlich
idiota imbécil estúpido basura escoria tonto patético inútil asqueroso payaso
""".split()
WORD = re.compile(r"[^\W_]+")
SHOUT = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{4,}\b")
MASKED = re.compile(r"(?<=\w)[*#@$%!]{2,}\w")
RUN = re.compile(r"[!?]{3,}")


LONGS = pa.list_(pa.int64())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def patterns(text: str) -> list[int]:
    """Votes of the pattern voters that need no lexicon."""
    words = max(1, text.count(" ") + 1)
    return [int(len(SHOUT.findall(text)) * 5 > words), int(bool(MASKED.search(text))), int(bool(RUN.search(text)))]


def steps(share: np.ndarray | float, at: tuple) -> np.ndarray:
    return np.array([np.asarray(share) >= t for t in at], float)


@dataclass
class Lexicon:
    """The mined features by their hashes."""

    index: dict[int, int] = field(default_factory=dict)

    def hits(self, word: str) -> tuple[int, ...]:
        own = (zlib.crc32(f.encode("utf-8", "replace")) for f in features_of(word))
        return tuple(self.index[h] for h in own if h in self.index)


class Reader:
    """What a text shows: its mined features, how many of its words each lexicon hits, its number of words, its patterns
    and whether it holds a listed insult."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known, self.insults = lexicon, {}, frozenset(INSULTS)

    def __call__(self, text: str | None) -> tuple[set[int], list[int], int, list[int], int]:
        text = text or ""
        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.lexicon.hits(w)
        found, counts = set(), [0] * LEXICONS
        for hit in filter(None, map(known.__getitem__, words)):
            found.update(hit)
            counts[min(hit) % LEXICONS] += 1
        return found, counts, len(words), patterns(text), int(not self.insults.isdisjoint(words))


@dataclass
class Model:
    """Weights of the mined features, the patterns and the steps of the share of mined words."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other_weights: np.ndarray = field(default_factory=lambda: np.zeros(3 + len(SHARES_ALL)))
    intercept: float = 0.0
    constant: float | None = None
    report: dict = field(default_factory=dict)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.read = model, Reader(model.lexicon)

    def __call__(self, text: str | None) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        found, counts, n, marks, _ = self.read(text)
        hits = sum(counts) if len(found) >= DIFFERENT[0] else 0
        z = m.intercept + float(np.dot(m.other_weights, [*marks, *(hits >= t * max(FEW_WORDS, n) for t in SHARES_ALL)]))
        if found:
            z += float(m.weights[list(found)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 per row from the voters' 0/1 votes, and what was estimated; `start` is a first guess."""
    v = votes.astype(np.float64)
    posterior = 0.05 + 0.9 * start
    for _ in range(rounds):
        total1, total0 = posterior.sum(), (1 - posterior).sum()
        prior = np.clip(total1 / len(v), 1e-3, 1 - 1e-3)
        hit1 = np.clip((posterior @ v + 0.5) / (total1 + 1), 1e-3, 1 - 1e-3)
        hit0 = np.clip(((1 - posterior) @ v + 0.5) / (total0 + 1), 1e-4, 1 - 1e-3)
        # correlation within the classes: what is left after each class's own rates
        left = v - posterior[:, None] * hit1 - (1 - posterior)[:, None] * hit0
        cov = left.T @ left / len(v)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        rho[rho < 0.1] = 0
        np.fill_diagonal(rho, 1)
        weight = 1 / rho.sum(1)
        one, zero = np.log(hit1 / hit0), np.log((1 - hit1) / (1 - hit0))
        z = np.log(prior / (1 - prior)) + v @ (weight * one) + (1 - v) @ (weight * zero)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    return posterior, {"prior": float(prior), "hit1": hit1, "hit0": hit0, "correlation": rho}


def fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft targets by Newton steps; the intercept is not penalised."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2000):  # in slices, for little memory
            z = np.concatenate([x[at : at + 2000].astype(np.float64), np.ones((len(x[at : at + 2000]), 1))], 1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = gradient + z.T @ (p - target[at : at + 2000])
            hessian = hessian + (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def hashes(names: list[str]) -> np.ndarray:
    """Sorted distinct 32-bit hashes of features."""
    return np.unique(np.fromiter((zlib.crc32(n.encode("utf-8", "replace")) for n in names), np.uint32, len(names)))


def unlike(words: list[np.ndarray], toxic: np.ndarray, common: float = 0.005) -> np.ndarray:
    """Rows to mine from: one of each set of near copies with the same label. Near copies are taken to share the
    smallest hash among their uncommon words."""
    names, counts = np.unique(np.concatenate(words), return_counts=True)
    frequent = names[counts > max(3.0, common * len(words))]
    seen, kept = set(), []
    for i, own in enumerate(words):
        rare = own[~np.isin(own, frequent, assume_unique=True)]
        rare = rare if len(rare) else own
        mark = (int(rare[0]) if len(rare) else -1, toxic[i])
        if mark not in seen:
            seen.add(mark)
            kept.append(i)
    return np.array(kept)


def mine(rows: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Features that stand out in toxic rows, strongest first: much more frequent there, with a likelihood ratio
    statistic above what the number of features tried would give by chance."""
    n1 = int(toxic.sum())
    n0 = len(rows) - n1
    ones = [r for r, y in zip(rows, toxic) if y]
    if not ones:
        return []
    tried, a = np.unique(np.concatenate(ones), return_counts=True)
    tried, a = tried[a >= 3], a[a >= 3].astype(float)
    b = np.zeros(len(tried))
    for r, y in zip(rows, toxic):
        if not y and len(tried):
            at = np.minimum(np.searchsorted(tried, r), len(tried) - 1)
            b[at[tried[at] == r]] += 1
    share = (a + b) / max(1, n1 + n0)

    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0)

    g = 2 * (part(a, n1, share) + part(n1 - a, n1, 1 - share) + part(b, n0, share) + part(n0 - b, n0, 1 - share))
    strong = (a / max(n1, 1) > LIFT * b / max(n0, 1)) & (g > 2 * np.log(max(1, len(tried)) / 0.05))
    order = sorted(np.flatnonzero(strong), key=lambda i: (-g[i], tried[i]))
    return [int(tried[i]) for i in order[:MAX_FEATURES]]


def fit(seen: list[tuple], lexicon: Lexicon) -> Model:
    """Vote, estimate and train on what Reader has seen of the sample."""
    n = np.array([max(FEW_WORDS, r[2]) for r in seen], float)
    counts, marks = np.array([r[1] for r in seen], float), np.array([r[3] for r in seen], float)
    shares = counts / n[:, None]
    different = np.array([len(r[0]) for r in seen])
    every = steps(np.where(different >= DIFFERENT[0], counts.sum(1), 0) / n, SHARES_ALL).T
    votes = np.concatenate([*(shares >= t for t in SHARES_ONE), every, steps(different, DIFFERENT).T, marks, np.array([[r[4]] for r in seen])], 1)
    posterior, report = label_model(votes, every[:, START])
    x = np.zeros((len(seen), len(lexicon.index)), np.float32)
    for i, r in enumerate(seen):
        x[i, list(r[0])] = 1
    weights, intercept = fit_logistic(np.concatenate([x, marks.astype(np.float32), every.astype(np.float32)], 1), posterior)
    return Model(lexicon, weights[: x.shape[1]], weights[x.shape[1] :], intercept, None, report)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    chosen = usable.groupBy(key).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), key)  # at most `sample` small rows
    rows = materialise(rows.groupBy(key).agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled-sample")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(start, BATCH_TEXTS)
                words, features = [], []
                for t in part.column(1):
                    own = list(set(WORD.findall((t.as_py() or "").lower())))
                    words.append(hashes(own).tobytes())
                    features.append(hashes([f for w in own for f in features_of(w)]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(words, pa.binary()), pa.array(features, pa.binary())], [key, "y", "words", "features"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.select(key, "text", "y").mapInArrow(run, f"{key} {kind}, y int, words binary, features binary").toArrow()  # a row an id of the sample
    order = np.argsort(np.array(found.column(key).to_pylist()), kind="stable")
    y = np.array(found.column("y").to_pylist(), float)[order]
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    words, features = ([np.frombuffer(found.column(c)[int(i)].as_py(), np.uint32) for i in order] for c in ("words", "features"))
    kept = unlike(words, y)
    lexicon = Lexicon({f: i for i, f in enumerate(mine([features[i] for i in kept], y[kept]))})
    del found, words, features

    def look(batches):
        read = Reader(lexicon)
        for batch in batches:
            seen = [read(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([list(s[c]) if c in (0, 1, 3) else s[c] for s in seen], t) for c, t in enumerate((LONGS, LONGS, pa.int64(), LONGS, pa.int64())))], [key, "found", "counts", "n", "marks", "listed"])

    shown = rows.select(key, "text").mapInArrow(look, f"{key} {kind}, found array<bigint>, counts array<bigint>, n bigint, marks array<bigint>, listed bigint").collect()  # a row an id of the sample
    return fit([tuple(r)[1:] for r in sorted(shown, key=lambda r: r[0])], lexicon)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`' key, held_out, score and predicted for every row."""
    slim = Model(model.lexicon, model.weights, model.other_weights, model.intercept, model.constant)

    def run(batches):
        scorer = Scorer(slim)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], [key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns; one pass and no shuffle of texts."""
    model = train(docs, labels, key, text)
    slim = Model(model.lexicon, model.weights, model.other_weights, model.intercept, model.constant)

    def run(batches):
        scorer = Scorer(slim)
        for batch in batches:
            keep = [scorer(None if t is None else str(t)) < 0.5 for t in (x.as_py() for x in batch.column(text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
