"""Quality by positive-unlabelled learning: non-negative risk over shape features."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import arrow_map, pick, stored

_WORD = re.compile(r"\w+")
_FEATURES = 14
_BINS = 12
# Bounds of the training: trusted positives and unlabelled documents.
SAMPLE_ROWS = 8000
_STEPS = 400
_BATCHES = 8
_SCORED = "doc_id bigint, score double"


def shape(text: str | None) -> list[float]:
    """Features of a whole text that do not depend on its language."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * _FEATURES
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(len, words))
    alone = sum(1 for w in words if not _WORD.search(w))
    raw = text.encode()
    upper, digit, other = _kinds(text)
    return [
        math.log1p(n),
        letters / n,
        len(set(words)) / n ** 0.8,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        upper / chars,
        digit / chars,
        other / chars,
        text.count("!") / n,
        alone / n,
        sum(text.count(c) for c in "#$%&*|<>{}=") / n,
        (text.count(".") + text.count(",")) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)) / (n + 1),
        len(zlib.compress(raw, 1)) / len(raw),
    ]


@functools.cache
def _table() -> np.ndarray:
    """Kind of each character of the basic plane: 1 upper case, 2 digit, 3 neither letter nor space, 0 other."""

    def kind(c: str) -> int:
        if c.isupper():
            return 1
        if c.isdigit():
            return 2
        return 0 if c.isalnum() or c.isspace() else 3

    return np.array([kind(chr(code)) for code in range(0x10000)], "u1")


def _kinds(text: str) -> tuple[int, int, int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_table()[np.minimum(codes, 0xFFFF)], minlength=4)
    return int(counts[1]), int(counts[2]), int(counts[3])


@dataclass
class QualityModel:
    """Edges of each feature's bins, and a weight for each bin."""

    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    prior: float = 0.5

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """For each row the places of its bins among the weights; the last weight is the constant."""
        return np.stack(
            [np.searchsorted(e, rows[:, i], side="right") + i * (_BINS + 1) for i, e in enumerate(self.edges)], axis=1
        )

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(rows), self.prior)
        z = self.weights[self.columns(rows)].sum(axis=1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def trained_fold(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(
    df: DataFrame, labels: DataFrame, train: Column, label: str = "quality", rows: int = SAMPLE_ROWS
) -> QualityModel:
    """A model learned from trusted positives that meet ``train`` (a condition on doc_id) and unlabelled text.

    The risk is that of non-negative positive-unlabelled learning: prior * risk of positives as
    positive, plus the risk of unlabelled text as negative less prior * that of positives as
    negative, where a batch whose second part is negative is stepped back from. The class prior
    is estimated from the two samples alone: no share of good text in the unlabelled can exceed,
    anywhere in feature space, the ratio of unlabelled to positive mass, so it is the least such
    ratio over the tails of a classifier of positives against unlabelled, with room for chance.

    The samples are bounded: up to ``rows`` positives and ``rows`` unlabelled documents, those with the
    smallest hashes of id and text, so copies of a text come by their share and repeated rows together.
    Labels that are null or negative do not count; without positives or text every score is the prior of
    one half.
    """
    known = pick(labels, "doc_id", label).toDF("doc_id", "y").where((F.col("y") > 0) & train)
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = pick(df, "doc_id", "text")
    total = texts.count()
    # Enough for ``rows`` but for chance; the hash decides which of them stay.
    rate = min(1.0, 1.2 * rows / max(1, total))
    order = F.xxhash64("doc_id", "text", F.lit(99))
    drawn = F.pmod(order, F.lit(1_000_000)) < math.ceil(rate * 1_000_000)
    # At most ``rows`` ids.
    marked = texts.join(F.broadcast(ids.withColumn("p", F.lit(1))), "doc_id", "left")
    sample = marked.where(F.col("p").isNotNull() | drawn).select(
        "text", F.coalesce("p", F.lit(0)).alias("p"), drawn.cast("int").alias("u"), order.alias("h")
    )

    def each(given: Iterator[dict]) -> Iterator[tuple]:
        for row in given:
            yield row["p"], row["u"], row["h"], shape(row["text"])

    found = stored(arrow_map(sample, each, "p int, u int, h bigint, x array<float>"), "quality-sample")
    first = lambda part: found.where(f"{part} = 1").orderBy("h", "x").limit(rows).select("x").collect()
    positive, unlabelled = (np.array([r["x"] for r in first(part)], "f8").reshape(-1, _FEATURES) for part in "pu")
    # The order in which rows arrive does not matter.
    positive, unlabelled = (x[np.lexsort(x.T[::-1])] for x in (positive, unlabelled))
    model = QualityModel()
    if not len(positive) or not len(unlabelled):
        return model
    both = np.concatenate((positive, unlabelled))
    model.edges = [np.quantile(both[:, i], np.arange(1, _BINS + 1) / (_BINS + 1)) for i in range(_FEATURES)]
    p, u = model.columns(positive), model.columns(unlabelled)
    size = _FEATURES * (_BINS + 1) + 1
    # A classifier of positives against unlabelled, for the prior.
    weights = _descend(p, u, size, lambda zp, zu: (-_sigmoid(-zp) / len(p), _sigmoid(zu) / len(u)), 200)
    model.prior = _prior(_scores(weights, p), _scores(weights, u))
    model.weights = _non_negative(p, u, size, model.prior)
    return model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scores(weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return weights[columns].sum(axis=1) + weights[-1]


def _slope(columns: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    out = np.bincount(columns.ravel(), np.repeat(slope, columns.shape[1]), minlength=size)
    out[-1] += slope.sum()
    return out


def _descend(p: np.ndarray, u: np.ndarray, size: int, slopes, steps: int) -> np.ndarray:
    state = _Adam(size)
    for _ in range(steps):
        sp, su = slopes(_scores(state.weights, p), _scores(state.weights, u))
        state.step(_slope(p, sp, size) + _slope(u, su, size) + 1e-4 * state.weights)
    return state.weights


def _non_negative(p: np.ndarray, u: np.ndarray, size: int, prior: float) -> np.ndarray:
    state = _Adam(size)
    random = np.random.default_rng(5)
    p, u = random.permutation(p), random.permutation(u)
    for step in range(_STEPS):
        bp, bu = p[step % _BATCHES :: _BATCHES], u[step % _BATCHES :: _BATCHES]
        if not len(bp) or not len(bu):
            bp, bu = p, u
        zp, zu = _scores(state.weights, bp), _scores(state.weights, bu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Slope of the risk of unlabelled as negative, less that of positives as negative.
        part = _slope(bu, _sigmoid(zu) / len(bu), size) - prior * _slope(bp, _sigmoid(zp) / len(bp), size)
        if negative < 0:
            state.step(-part)
        else:
            state.step(part - prior * _slope(bp, _sigmoid(-zp) / len(bp), size) + 1e-4 * state.weights)
    return state.weights


def _prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass over upper tails, with room for chance."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.8, 81)))
    best = 1.0
    for cut in cuts:
        mass = (positive >= cut).mean()
        room = math.sqrt(0.5 / len(unlabelled)) + math.sqrt(0.5 / len(positive))
        best = min(best, ((unlabelled >= cut).mean() + room) / mass)
    return float(min(0.99, max(0.01, best)))


class _Adam:
    def __init__(self, size: int):
        self.weights, self._mean, self._var, self._n = np.zeros(size), np.zeros(size), np.zeros(size), 0

    def step(self, slope: np.ndarray, rate: float = 0.05) -> None:
        self._n += 1
        self._mean = 0.9 * self._mean + 0.1 * slope
        self._var = 0.99 * self._var + 0.01 * slope**2
        mean, var = self._mean / (1 - 0.9**self._n), self._var / (1 - 0.99**self._n)
        self.weights = self.weights - rate * mean / (np.sqrt(var) + 1e-8)


def quality(df: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of ``df``: doc_id and score (0 to 1, higher for better text).

    Whole texts are scored; nothing is shuffled. Null and empty texts have all features zero.
    Null and repeated ids keep their rows; extra columns are ignored; an empty table gives no rows.
    """

    def each(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            yield row["doc_id"], float(model.score(np.array([shape(row["text"])], "f4").astype("f8"))[0])

    return arrow_map(pick(df, "doc_id", "text"), each, _SCORED)
