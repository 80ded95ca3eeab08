"""Toxic spans by a linear-chain conditional random field, and document scores from them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import arrow_map, nested, pick, stored, unnested

_TOKEN = re.compile(r"\w+|[.!?\n]")
_WORD = re.compile(r"\w+")
_SCORED = "doc_id bigint, score double, spans string"
# Bounds of the training: rows of each class, characters of a row, sentences and their tokens.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
_SENTENCES = 3000
_SENTENCE_TOKENS = 64
_STEPS = 120
# Word evidence: documents needed, and how much likelier in toxic ones.
_LEAST_SHARE = 0.02
_LEAST_RATIO = 25.0
_LEVELS = 3
# Inflected words share a stem: beginnings of so many letters are evidence too.
_STEMS = (4, 5, 6)
_FEATURES = _LEVELS + 3
# Marginals below this do not count towards the score.
_FLOOR = 0.05


@dataclass
class ToxicModel:
    """``levels``: strength (1 to 3) of evidence words and stems. State 0 is clean, state 1 toxic."""

    levels: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_FEATURES))
    # start in 1, and the steps 0-1, 1-0 and 1-1 against 0-0.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(4))
    document: np.ndarray = field(default_factory=lambda: np.array([-7.0, 0.0, 0.0]))
    _heads: frozenset[str] = frozenset()

    def learn(self, levels: dict[str, int]) -> None:
        self.levels = levels
        self._heads = frozenset(unit[: _STEMS[0]] for unit in levels)

    def level(self, word: str) -> int:
        """Strength of the best evidence in a lower-case word."""
        get = self.levels.get
        best = get(word, 0)
        if word[: _STEMS[0]] in self._heads:
            for k in _STEMS:
                if len(word) > k:
                    best = max(best, get(word[:k] + "*", 0))
        return best

    def may_hold(self, text: str) -> bool:
        """False only if no word of the text is evidence."""
        return not self._heads.isdisjoint([word[: _STEMS[0]] for word in _WORD.findall(text.lower())])

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """Probability that a text is toxic, and its toxic spans in code points.

        Sentences without an evidence word hold no toxic token.
        """
        total = most = 0.0
        spans: list[tuple[int, int]] = []
        if text and self.may_hold(text):
            for places, levels in _sentences(text, self):
                if not any(levels):
                    continue
                for (start, end), p in zip(places, self._marginals(levels), strict=True):
                    if p >= _FLOOR:
                        total += p
                        most = max(most, p)
                    if p >= 0.5:
                        spans.append((start, end))
        z = float(self.document @ np.array([1.0, math.log1p(total), most]))
        return 1.0 / (1.0 + math.exp(-z)), spans

    def _marginals(self, levels: list[int]) -> list[float]:
        """Probability of state 1 at each token, by forward and backward passes over odds."""
        emit = [math.exp(x) for x in _features(np.array([levels]))[0] @ self.weights]
        start, up, down, stay = (math.exp(x) for x in self.steps)
        ahead = []
        clean, toxic = 1.0, start * emit[0]
        for t, e in enumerate(emit):
            if t:
                clean, toxic = clean + toxic * down, (clean * up + toxic * stay) * e
            norm = clean + toxic
            clean, toxic = clean / norm, toxic / norm
            ahead.append((clean, toxic))
        found = []
        clean, toxic = 1.0, 1.0
        for t in range(len(emit) - 1, -1, -1):
            a, b = ahead[t][0] * clean, ahead[t][1] * toxic
            found.append(b / (a + b))
            clean, toxic = clean + up * emit[t] * toxic, down * clean + stay * emit[t] * toxic
            norm = clean + toxic
            clean, toxic = clean / norm, toxic / norm
        return found[::-1]


def _sentences(text: str, model: ToxicModel) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    places: list[tuple[int, int]] = []
    found: list[int] = []
    for match in _TOKEN.finditer(text):
        if match[0] in ".!?\n":
            if places:
                yield places, found
                places, found = [], []
        else:
            places.append(match.span())
            found.append(model.level(match[0].lower()))
    if places:
        yield places, found


def _features(levels: np.ndarray) -> np.ndarray:
    """One-hot level, and whether the neighbours are evidence words."""
    out = np.zeros((*levels.shape, _FEATURES))
    for level in range(_LEVELS + 1):
        out[..., level] = levels == level
    out[:, 1:, _LEVELS + 1] = levels[:, :-1] > 0
    out[:, :-1, _LEVELS + 2] = levels[:, 1:] > 0
    return out


def fit(df: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicModel:
    """A model learned from the labelled documents that meet ``train``, a condition on doc_id.

    Labels are of documents; tokens get theirs from them. Evidence is a word, or a beginning of
    words, that toxic documents hold at least 25 times as often as others, in 2 % of them at least, near copies
    counted once. Such tokens in toxic documents are labelled toxic, all other tokens clean, and the field learns
    how much each strength of evidence and each neighbour counts. Marginals are then summed to
    document scores by logistic regression.

    The sample is bounded: ``rows`` documents of each class, chosen by a hash of the id and of the text, of
    up to 20,000 characters, repeated rows once; the field learns from up to 3000 of their sentences of up to
    64 words. A document with several labels is toxic if one of them is; null labels
    and ids do not count. Without toxic or without clean examples every score is near 0.
    """
    known = pick(labels, "doc_id", label).toDF("doc_id", "y").where(F.col("y").isNotNull() & train)
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    known = stored(known, "labels")
    counts = dict(known.groupBy("y").count().collect())
    halves = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)
    ]
    # At most 2 * rows ids.
    chosen = F.broadcast(halves[0].union(halves[1]))
    texts = pick(df, "doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    once = texts.withColumn("h", F.xxhash64("doc_id", "text")).join(chosen, "doc_id").dropDuplicates(["doc_id", "h"])
    once = stored(once.select("text", "y", "h"), "toxic-sample")
    found = [r for y in (0, 1) for r in once.where(F.col("y") == y).orderBy("h", "text").limit(rows).collect()]
    sample = sorted({(r["text"], r["y"]) for r in found})
    toxic = [text for text, y in sample if y]
    clean = [text for text, y in sample if not y]
    model = ToxicModel()
    if not toxic or not clean:
        return model
    model.learn(_evidence(toxic, clean))
    _train_chain(model, toxic, clean)
    _train_document(model, toxic, clean, counts.get(1, 0) / max(1, counts.get(0, 0)))
    return model


def _units(text: str) -> set[str]:
    """The words of a text, and their beginnings of four to six letters, marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {word[:k] + "*" for word in words for k in _STEMS if len(word) > k}


def _evidence(toxic: list[str], clean: list[str]) -> dict[str, int]:
    """Evidence words and stems, and their strength."""
    # Near copies mostly share their least hash, and count once for a word.
    groups = [min((zlib.crc32(w.encode()) for w in set(_WORD.findall(t.lower()))), default=0) for t in toxic]
    n_groups = len(set(groups))
    least = max(3, math.ceil(_LEAST_SHARE * n_groups))
    seen: Counter = Counter()
    for text in toxic:
        seen.update(_units(text))
    held: dict[str, set[int]] = {unit: set() for unit, n in seen.items() if n >= least}
    del seen
    for group, text in zip(groups, toxic, strict=True):
        for unit in _units(text) & held.keys():
            held[unit].add(group)
    elsewhere: Counter = Counter()
    for text in clean:
        elsewhere.update(_units(text) & held.keys())
    chosen = {}
    for unit, found in held.items():
        ratio = (len(found) / n_groups) / ((elsewhere[unit] + 0.5) / len(clean))
        if len(found) >= least and ratio >= _LEAST_RATIO:
            strength = math.log(ratio / _LEAST_RATIO)
            chosen[unit] = 1 + (strength > 1.5) + (strength > 3.0)
    return chosen


def _train_chain(model: ToxicModel, toxic: list[str], clean: list[str]) -> None:
    """Adam on the conditional likelihood of labelled sentences, padded to one length."""
    held: list[tuple[list[int], int]] = []
    plain = 0
    for y, texts in ((1, toxic), (0, clean)):
        for text in texts:
            for _, levels in _sentences(text, model):
                if len(levels) > _SENTENCE_TOKENS:
                    continue
                if any(levels):
                    held.append((levels, y))
                elif plain < _SENTENCES // 4:
                    plain += 1
                    held.append((levels, y))
    held = held[:: -(-len(held) // _SENTENCES)] if held else []
    if not any(any(levels) and y for levels, y in held):
        return
    width = max(len(levels) for levels, _ in held)
    level = np.zeros((len(held), width), "i8")
    gold = np.zeros((len(held), width))
    real = np.zeros((len(held), width), bool)
    for i, (levels, y) in enumerate(held):
        level[i, : len(levels)] = levels
        real[i, : len(levels)] = True
        gold[i, : len(levels)] = [float(y and x > 0) for x in levels]
    features = _features(level)
    state = np.zeros(_FEATURES + 4)
    mean, var = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, _STEPS + 1):
        gradient = _gradient(state, features, gold, real) / len(held) - 0.001 * state
        mean = 0.9 * mean + 0.1 * gradient
        var = 0.99 * var + 0.01 * gradient**2
        state = state + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    model.weights, model.steps = state[:_FEATURES], state[_FEATURES:]


def _gradient(state: np.ndarray, features: np.ndarray, gold: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Observed minus expected counts of features and steps."""
    emit = np.exp(features @ state[:_FEATURES])
    start, up, down, stay = np.exp(state[_FEATURES:])
    n, width = gold.shape
    ahead = np.zeros((width, 2, n))
    behind = np.ones((width, 2, n))
    for t in range(width):
        if t == 0:
            now = np.stack([np.ones(n), start * emit[:, 0]])
        else:
            c, x = ahead[t - 1]
            now = np.stack([c + x * down, (c * up + x * stay) * emit[:, t]])
            now = np.where(real[:, t], now, ahead[t - 1])
        ahead[t] = now / now.sum(axis=0)
    for t in range(width - 2, -1, -1):
        c, x = behind[t + 1]
        e = emit[:, t + 1]
        now = np.stack([c + up * e * x, down * c + stay * e * x])
        behind[t] = np.where(real[:, t + 1], now / now.sum(axis=0), behind[t + 1])
    both = ahead * behind
    p = (both[:, 1] / both.sum(axis=1)).T * real
    out = np.zeros(_FEATURES + 4)
    out[:_FEATURES] = np.einsum("nt,ntf->f", gold - p, features)
    out[_FEATURES] = (gold[:, 0] - p[:, 0]).sum()
    for t in range(1, width):
        on = real[:, t]
        c, x = ahead[t - 1][:, on]
        bc, bx = behind[t][:, on]
        e = emit[on, t]
        joint = np.stack([c * bc, c * up * e * bx, x * down * bc, x * stay * e * bx])
        joint = joint / joint.sum(axis=0)
        before, now = gold[on, t - 1], gold[on, t]
        out[_FEATURES + 1] += ((1 - before) * now).sum() - joint[1].sum()
        out[_FEATURES + 2] += (before * (1 - now)).sum() - joint[2].sum()
        out[_FEATURES + 3] += (before * now).sum() - joint[3].sum()
    return out


def _train_document(model: ToxicModel, toxic: list[str], clean: list[str], odds: float) -> None:
    """Weighted logistic regression by Newton steps; classes weigh as in the population."""
    rows = []
    model.document = np.zeros(3)
    for text in toxic + clean:
        total = most = 0.0
        if model.may_hold(text):
            for _, levels in _sentences(text, model):
                if any(levels):
                    for p in model._marginals(levels):
                        if p >= _FLOOR:
                            total += p
                            most = max(most, p)
        rows.append((1.0, math.log1p(total), most))
    x = np.array(rows)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    # The sample has its own ratio of classes.
    w = np.where(y == 1, odds * len(clean) / len(toxic), 1.0)
    beta = np.zeros(3)
    ridge = np.diag([0.001, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge @ beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.document = beta


def toxicity(df: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per row of ``df``: doc_id, score (0 to 1) and spans (start:end, comma-joined).

    Whole texts are tagged; nothing is shuffled. Spans are code points of words whose marginal
    is at least a half. Null and empty texts have no spans and the score of a text without
    evidence. Null and repeated ids keep their rows; extra columns are ignored; an empty table
    gives no rows.
    """

    def each(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            score, spans = model.score(row["text"])
            yield row["doc_id"], score, ",".join(f"{a}:{b}" for a, b in spans)

    return arrow_map(pick(df, "doc_id", "text"), each, _SCORED)


def trained_fold(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def without_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, unchanged.

    Null and empty texts have the score of a text without evidence; null ids and repeated rows are
    judged as any. Extra columns stay, whatever their names; an empty table gives no rows.
    """
    model = fit(df, labels, trained_fold(F.col("doc_id")))
    rows, col = nested(df)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda text: model.score(text)[0])

    return unnested(rows.where(score(col("text")) < threshold), df.columns)
