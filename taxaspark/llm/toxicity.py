"""Toxicity by weak supervision.

Lexicon entries (words, and beginnings that several different words of a text share, mined from labelled
rows) and text patterns in four languages vote on each text of a bounded labelled sample. A generative
label model estimates, by expectation maximisation, how often each voter fires on toxic and on clean
texts; the given label is one more voter, whose errors it estimates too, so a label that the others
contradict is overruled. Voters that fire together more than their class explains are one correlated
clique and share one vote's weight; cliques are estimated again in every round, from the classes as the
model has them then. A voter that doesn't fire abstains; that none fires is a vote of its own. A linear
classifier over words and beginnings is then trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote, each in English, German, French and Spanish where it has words.
PATTERNS = (
    ("insult", re.compile(r"(?i)\b(?:you(?:'re| are)? (?:such )?an? \w+|du (?:bist )?(?:ein(?:e)? )?(?:idiot|dummkopf|versager|arschloch)|(?:tu es|espèce d[e']) ?(?:un |une )?(?:idiot|imbécile|abruti|con)|eres (?:un |una )?(?:idiota|imbécil|estúpid[oa]|inútil))\b")),
    ("threat", re.compile(r"(?i)\b(?:(?:kill|hurt|shoot|burn|destroy) (?:you|him|her|them)|(?:ich )?(?:bringe? dich um|mach dich fertig)|je vais te (?:tuer|frapper)|te voy a (?:matar|pegar))\b")),
    ("hate", re.compile(r"(?i)\b(?:i (?:hate|despise) (?:you|them|all)|ich hasse (?:dich|euch|sie)|je (?:te|vous|les) (?:déteste|hais)|(?:te|los|las) odio)\b")),
    ("shut up", re.compile(r"(?i)\b(?:shut up|go to hell|halt(?:'s| die) (?:maul|klappe|fresse)|fahr zur hölle|ferme(?:-la| ta gueule)|va te faire|cállate|vete al (?:infierno|diablo))\b")),
    ("shouting", re.compile(r"(?:\b[A-Z]{4,}\b\W+){5,}")),
    ("marks", re.compile(r"[!?]{4,}")),
)
BEGINNINGS = range(3, 9)
#: A beginning is a feature for each of these numbers of different words of a text that have it.
TIMES = (1, 2, 3)


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) > k]


def features(text: str | None) -> set[str]:
    """Words, and beginnings with the number of words that share one at least: "ab*2"."""
    words = set(WORD.findall((text or "").lower()))
    shared = Counter(b for w in words for b in beginnings(w))
    return words.union(f"{b}*{t}" for b, n in shared.items() for t in TIMES if n >= t)


@dataclass
class LabelModel:
    """Rates at which voters fire on clean and on toxic texts, and the weight left by correlations.

    ``quiet``: rates at which no voter fires; ``label``: rates at which the given label is 1.
    """

    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    quiet: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))
    label: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))
    prior: float = 0.1

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Chance of label 1 given ``votes`` (rows by voters, 0 or 1) and the label voter's vote."""
        odds = lambda r: np.log(np.clip(r[1], 1e-4, 1 - 1e-4)) - np.log(np.clip(r[0], 1e-4, 1 - 1e-4))
        total = np.clip(votes @ (odds(self.rates) * self.share), -30, 30) + (votes.sum(axis=1) == 0) * odds(self.quiet)
        total = total + np.where(gold > 0, odds(self.label), odds(1 - self.label)) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def fit(self, votes: np.ndarray, gold: np.ndarray, rounds: int = 20, without: int = 10) -> LabelModel:
        """The labels only begin: classes, cliques and all rates are then the model's own, and for the
        first rounds the label has no vote, so that its errors are seen. Estimates start from a few
        supposed texts: a voter fires on 1 in 20, a label errs on 1 in 10. How many toxic texts make no
        voter fire can't be seen in the votes, so that 1 in 10 does is supposed of many."""
        silent = votes.sum(axis=1) == 0
        q = np.where(gold > 0, 0.9, 0.1)
        for k in range(rounds):
            totals = np.array([(1 - q).sum(), q.sum()])
            rate = lambda x, supposed, n: (np.array([(1 - q) @ x, q @ x]) + np.array(supposed) * n) / (totals + n)  # noqa: B023, E731
            self.rates = (np.stack([(1 - q) @ votes, q @ votes]) + 0.025) / (totals[:, None] + 0.5)
            self.quiet = rate(silent, (0.9, 0.1), len(gold) / 2)
            if k >= without:
                self.label = rate(gold, (0.1, 0.9), 20)
            self.prior = float(np.clip(q.mean(), 0.01, 0.99))
            self.share = self._shares(votes, q)
            q = self.posterior(votes, gold)
        return self

    def _shares(self, votes: np.ndarray, q: np.ndarray, least: float = 0.3) -> np.ndarray:
        """1 / size of a voter's clique: itself and those it correlates with given the class."""
        toxic = (q > 0.5).astype(float)
        means = [(c @ votes) / max(1.0, c.sum()) for c in (1 - toxic, toxic)]
        left = votes - np.outer(toxic, means[1]) - np.outer(1 - toxic, means[0])
        deviation = np.sqrt((left**2).mean(axis=0)) + 1e-9
        correlation = (left.T @ left) / len(votes) / np.outer(deviation, deviation)
        return 1 / np.maximum(1, (np.abs(correlation) > least).sum(axis=1))


@dataclass
class Scorer:
    """A linear classifier over words and shared beginnings."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.begins = {f.split("*")[0] for f in self.weights if "*" in f}
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        found, shared = [], Counter()
        if len(self.known) > 500_000:
            self.known.clear()
        for word in set(WORD.findall((text or "").lower())):
            hit = self.known.get(word)
            if hit is None:
                hit = self.known[word] = tuple(b for b in beginnings(word) if b in self.begins)
            if hit:
                shared.update(hit)
            if word in self.weights:
                found.append(word)
        found += [f for b, n in shared.items() for t in TIMES if n >= t and (f := f"{b}*{t}") in self.weights]
        odds = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def count_features(texts: list[str | None], gold: np.ndarray, least_count: int) -> dict[str, list[int]]:
    """(rows without label 1, rows with it) of the features that ``least_count`` toxic rows have."""
    toxic: Counter[str] = Counter()
    for t, y in zip(texts, gold, strict=True):
        if y:
            toxic.update(features(t))
    counts = {f: [0, n] for f, n in toxic.items() if n >= least_count}
    for t, y in zip(texts, gold, strict=True):
        if not y:
            for f in features(t) & counts.keys():
                counts[f][0] += 1
    return counts


def mine(counts: dict[str, list[int]], n: tuple[int, int], most: int, least_odds: float) -> list[str]:
    """Features that toxic rows have far more often than clean ones, by the odds' lower bound; a
    shorter feature of the same counts as a longer one is taken for the same and left out."""
    odds = {}
    for f, (clean, toxic) in counts.items():
        p, q = (toxic + 0.3) / (n[1] + 0.6), (clean + 0.3) / (n[0] + 0.6)
        z = math.log(p / q) - 1.3 * math.sqrt(1 / (toxic + 0.3) + 1 / (clean + 0.3))
        if z > least_odds:
            odds[f] = z * math.sqrt(toxic)
    out, seen = [], set()
    for f in sorted(odds, key=lambda f: (-odds[f], -len(f), f)):
        key = (*counts[f], f[:3])
        if key not in seen:
            seen.add(key)
            out.append(f)
    return out[:most]


def train(texts: list[str | None], gold: list[int], lexicon: int = 200, vocabulary: int = 3000, least_share: float = 0.02, rounds: int = 400) -> Scorer:
    """Mine voters, fit the label model, then the classifier on its posterior labels."""
    y = np.array(gold, float)
    if not len(y) or y.min() == y.max():
        return Scorer({}, -4.0 if not len(y) or not y.max() else 4.0)
    n = (int((y == 0).sum()), int((y == 1).sum()))
    counts = count_features(texts, y, max(2, math.ceil(least_share * n[1])))
    voters = mine(counts, n, lexicon, 1.5)
    names = mine(counts, n, vocabulary, 1.0)
    voter = {f: k for k, f in enumerate(voters)}
    place = {f: k for k, f in enumerate(names)}
    votes = np.zeros((len(y), len(voters) + len(PATTERNS)))
    at: list[tuple[int, int]] = []
    for row, t in enumerate(texts):
        found = features(t)
        votes[row, [voter[f] for f in found & voter.keys()]] = 1
        at += [(row, place[f]) for f in sorted(found & place.keys())]
        for k, (_, pattern) in enumerate(PATTERNS, len(voters)):
            votes[row, k] = bool(pattern.search(t or ""))
    q = LabelModel().fit(votes, y).posterior(votes, y)
    if not at:
        return Scorer({}, math.log(q.mean() / (1 - q.mean())))
    return classifier(np.array(at), names, q, rounds)


def classifier(at: np.ndarray, names: list[str], q: np.ndarray, rounds: int) -> Scorer:
    """Logistic regression on posterior labels by adaptive steps. ``at``: (row, feature) of those present;
    weights aren't negative, as every feature was mined for label 1."""
    rows, cols = at.T
    w, b, gw, gb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6), 1e-6
    scale = np.where(q > 0.5, 0.25 / max(1, (q > 0.5).sum()), 0.25 / max(1, (q <= 0.5).sum())) + 0.5 / len(q)
    for _ in range(rounds):
        odds = np.bincount(rows, w[cols], len(q)) + b
        error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - q) * scale
        grad = np.bincount(cols, error[rows], len(names)) + 1e-4 * w
        gw, gb = gw + grad**2, gb + error.sum() ** 2
        w, b = np.maximum(0, w - 0.3 * grad / np.sqrt(gw)), b - 0.3 * error.sum() / math.sqrt(gb)
    return Scorer({f: float(v) for f, v in zip(names, w, strict=True) if v > 1e-3}, float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> list[tuple[str | None, int]]:
    """At most about ``most`` labelled texts of at most ``longest`` bytes, chosen by a digest of the id,
    with their labels. Of rows that repeat an id the least text is taken."""
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 950_000 * most / n)
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    rows = short.join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").limit(most)
    return [(r["text"], r["toxic"]) for r in rows.select("text", "toxic", "doc_id").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 1 << 15) -> Scorer:
    """``most``, ``longest``: bounds, in rows and in bytes of a text, of the labelled sample that the
    driver trains on; scoring covers all rows and whole texts.

    Texts beyond it are not read for training. Of a document labelled twice the higher label holds.
    """
    sample = labelled_sample(docs, labels, most, longest)
    return train([t for t, _ in sample], [y for _, y in sample])


def toxicity(text: Column, scorer: Scorer) -> Column:
    """Score from 0 to 1; null and empty texts get the score of a text without known words."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(of, "double")(text)
