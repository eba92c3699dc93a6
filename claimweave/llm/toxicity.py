"""Operator 2: a toxicity classifier that does not mind which group a text names.

Logistic regression over the words that tell labelled documents apart. For every labelled sentence that names a
group, the term is swapped for the others of its kind, and training penalises the change of score between the
sentence and its counterfactuals. A labelled document that names none gets a mention that its words' hashes choose;
the change of score from no mention to that one, and from that one to the others of its kind, is penalised alike. So a
neutral mention costs nothing, and no group is scored unlike another, also where few texts name one. Near copies count
once in training: of documents with one label, equal least hashes and COPY of their words in common, the first stays.

Edge cases: a null or empty text has no words and gets the score of the intercept; repeated rows get equal
scores; without usable labels every score is the smoothed base rate; empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from claimweave.llm.common import fold, labelled_sample

#: Labelled rows that the model is trained on, at most, and words that it may keep.
TRAINING_ROWS, WORDS = 20_000, 4_000
#: Documents that must hold a word before it can be kept.
LEAST = 4
#: Least hashes that near copies share, and the share of all their words.
SKETCH, COPY = 4, 0.8
PREDICTED_FROM = 0.7
#: Terms that name groups; those in one line are swapped for each other.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"), ("female", "male", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "lesbian", "bisexual", "straight"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"), ("immigrant", "native", "refugee"),
    ("old", "young", "elderly"), ("deaf", "blind", "disabled"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"), ("frau", "mann"), ("frauen", "männer"),
    ("muslime", "christen", "juden"), ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"),
)
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Model:
    weight: dict[str, float]
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        known, of = self.weight.keys(), self.weight
        raw = np.array([sum(of[w] for w in sorted(known & set(_WORD.findall((t or "").lower())))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(raw + self.intercept, -40, 40)))


class Sample:
    """Labelled texts as arrays of word hashes; of the texts themselves only sentences that name a group are kept."""

    def __init__(self, terms):
        self.swaps = {t: [o for o in group if o != t] for group in terms for t in group}
        self.terms, self.mention = sorted(self.swaps), []
        self.hashes: list[np.ndarray] = []
        self.labels: list[int] = []
        self.named: list[list[set[str]]] = []
        self.seen: dict = {}
        self.counts: Counter = Counter()
        self.words: dict[int, str] = {hash_of(t): t for t in self.swaps}

    def add(self, text: str, label: int) -> None:
        words = set(_WORD.findall(text.lower()))
        of = {hash_of(w): w for w in words}
        own = np.sort(np.fromiter(of, np.uint64, len(of)))
        # near copies of one document must not make its rare words look telling
        alike = self.seen.setdefault((label, *own[:SKETCH].tolist()), [])
        for other in alike:
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= COPY * (len(own) + len(other) - both):
                return
        alike.append(own)
        self.counts.update(of.keys())
        for h in of:
            if self.counts[h] == LEAST:
                self.words[h] = of[h]
        found = words & self.swaps.keys()
        self.mention.append(self.terms[int(own[0]) % len(self.terms)] if len(own) and self.terms and not found else None)
        self.named.append([s & (self.swaps.keys()) for s in map(set, map(_WORD.findall, _SENTENCE.split(text.lower()))) if s & found] if found else [])
        self.hashes.append(own)
        self.labels.append(label)


def _telling_words(sample: Sample, y: np.ndarray, most: int) -> list[int]:
    """Hashes of words whose documents are labelled 1 or 0 far from the base rate."""
    p = y.mean()
    ones = Counter(h for own, label in zip(sample.hashes, y) if label for h in own.tolist() if sample.counts[h] >= LEAST)
    z = {h: (ones[h] - n * p) / np.sqrt(n * p * (1 - p)) for h, n in sample.counts.items() if n >= LEAST}
    return sorted((h for h in z if abs(z[h]) >= 4.5), key=lambda h: (-abs(z[h]), h))[:most]


def fit(sample: Sample, most: int = WORDS, fairness: float = 1.0, ridge: float = 0.02, steps: int = 300) -> Model:
    y = np.array(sample.labels, float)
    p = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(p / (1 - p)))
    if not len(y) or not 0 < y.sum() < len(y):
        return Model({}, intercept)
    place = {h: k for k, h in enumerate(dict.fromkeys([*_telling_words(sample, y, most), *map(hash_of, sample.swaps)]))}
    known = np.sort(np.array(list(place), np.uint64))
    hits = [[place[h] for h in own[np.isin(own, known)].tolist()] for own in sample.hashes]
    row = np.repeat(np.arange(len(y)), [len(h) for h in hits])
    col = np.array([k for h in hits for k in h], np.int64)
    # the difference that each swap makes to a labelled sentence, as pairs of columns; the last one stands for no mention
    changes, none = Counter(), len(place)
    for term in sample.mention:
        if term is not None:
            changes[none, place[hash_of(term)]] += 1
            for other in sample.swaps[term]:
                changes[place[hash_of(term)], place[hash_of(other)]] += 1
    for sentences in sample.named:
        for found in sentences:
            for term in found:
                for other in sample.swaps[term]:
                    if other not in found:
                        changes[place[hash_of(term)], place[hash_of(other)]] += 1
    away, to = (np.array([c[i] for c in changes], np.int64) for i in (0, 1))
    times = np.array(list(changes.values()), float)
    times = times / max(1.0, times.sum())
    w, m, v = np.zeros(len(place)), np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, steps + 1):
        raw = intercept + np.bincount(row, w[col], len(y))
        residual = (1 / (1 + np.exp(-raw)) - y) / len(y)
        grad = np.bincount(col, residual[row], len(w)) + ridge / len(y) * w
        own = np.append(w, 0.0)
        gap = fairness * times * (own[to] - own[away])
        grad += (np.bincount(to, gap, len(own)) - np.bincount(away, gap, len(own)))[:none]
        grad = np.append(grad, residual.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, intercept = w - move[:-1], intercept - move[-1]
    return Model({sample.words[h]: float(w[k]) for h, k in place.items() if abs(w[k]) > 1e-3}, float(intercept))


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode())


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = TRAINING_ROWS, terms=IDENTITY_TERMS) -> Model:
    """From at most `most` labelled rows, which the driver takes one partition of the sample at a time."""
    sample = Sample(terms)
    for r in labelled_sample(docs, labels, label, usable, most).orderBy("doc_id").toLocalIterator():
        sample.add(r["text"], r["y"])
    return fit(sample)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(b["text"].tolist())})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels, fold("doc_id", 3) != 1))
    return out.withColumns({"held_out": fold("doc_id", 3) == 1, "predicted": (out["score"] >= PREDICTED_FROM).cast("int")})
