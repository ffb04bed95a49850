"""A quality classifier that learns from trusted good texts and unlabelled ones.

The risk of a classifier over all texts is estimated without negatives: with the class prior p, the
negatives' part is the unlabelled rows' risk as negatives minus p times the positives' risk as
negatives. That part cannot truly be negative; where a step's estimate is, the step goes back on it
instead of following it (non-negative risk). The model is a small network over a text's form.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped, texts
from pulseline.llm.labelled import held_out, sampled, training_labels

# Rows of each kind (trusted positives, unlabelled) that a model is fitted on, at most.
SAMPLE = 12_000
SYMBOLS = np.frombuffer(b"*$%&#@^~<>{}[]\\=+_", dtype=np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", dtype=np.uint8)


def form(text: str) -> list[float]:
    """Numbers about the form of a whole text: words, letters, symbols, repetition and lines."""
    words = text.split()
    n = max(len(words), 1)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256)
    chars = max(len(text), 1)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, islice(words, 1, None)))
    alphabetic = sum(map(str.isalpha, words))
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        sum(map(len, words)) / n,
        upper / max(upper + lower, 1),
        digits / chars,
        seen[SYMBOLS].sum() / n,
        seen[PUNCTUATION].sum() / n,
        seen[33] / n,
        seen[124] / n,
        (seen[0:9].sum() + seen[127]) / chars,
        seen[192:].sum() / chars,
        alphabetic / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(len(w) == 1 for w in words) / n,
        sum(len(w) > 20 for w in words) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(words)) / n**0.8,
        1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        float(not words),
    ]


def prior_of(labels: DataFrame) -> float | None:
    """The class prior, estimated as the share of positives among the training labels."""
    return labels.agg(F.avg("label")).first()[0]


class Network:
    """One hidden layer over standardised features; ``score`` is the probability of class 1."""

    def __init__(self, mean, scale, parts):
        self.mean, self.scale, self.parts = mean, scale, parts

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_pu(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    hidden: int = 16,
    epochs: int = 60,
    batch: int = 1024,
    rate: float = 0.01,
    decay: float = 1e-4,
    seed: int = 5,
) -> Network:
    """Minimise the non-negative unbiased risk with the logistic loss by Adam, in mini-batches."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    width = both.shape[1]
    parts = [
        rng.normal(0, width**-0.5, (width, hidden)),
        np.zeros(hidden),
        rng.normal(0, hidden**-0.5, hidden),
        np.array(0.0),
    ]
    first, second, steps = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    standard = lambda x: np.clip((x - mean) / scale, -6, 6)
    p_all, u_all = standard(positive), standard(unlabelled)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    rounds = max(1, -(-len(u_all) // batch))
    rounds_in_all = max(epochs * rounds, 600)
    for step in range(rounds_in_all):
        p = p_all[rng.integers(0, len(p_all), min(batch, len(p_all)))]
        u = u_all[rng.integers(0, len(u_all), min(batch, len(u_all)))]
        x = np.vstack([p, u])
        a, b, c, d = parts
        h = np.tanh(x @ a + b)
        g = h @ c + d
        gp, gu = g[: len(p)], g[len(p) :]
        soft = lambda v: np.logaddexp(0, v)  # noqa: E731  loss as a negative
        negative_part = soft(gu).mean() - prior * soft(gp).mean()
        slope = np.zeros(len(x))
        if negative_part >= 0:
            # Positives as positives, minus positives as negatives, plus unlabelled as negatives.
            slope[: len(p)] = prior * (sigmoid(gp) - 1) / len(p) - prior * sigmoid(gp) / len(p)
            slope[len(p) :] = sigmoid(gu) / len(u)
        else:
            slope[: len(p)] = prior * sigmoid(gp) / len(p)
            slope[len(p) :] = -sigmoid(gu) / len(u)
        back = np.outer(slope, c) * (1 - h * h)
        slopes = [x.T @ back + decay * a, back.sum(0), h.T @ slope + decay * c, np.array(slope.sum())]
        steps += 1
        now = rate * (0.5 + 0.5 * np.cos(np.pi * step / rounds_in_all))
        for i, s in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.999 * second[i] + 0.001 * s * s
            parts[i] = parts[i] - now * (first[i] / (1 - 0.9**steps)) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
    return Network(mean, scale, parts)


def matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in values]).reshape(len(values), -1)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The model of ``docs`` and their training labels; None if nothing can be learned from them.

    Only the ids are read to choose the sample; only the sample's texts come to be described.
    """
    shipped(__name__)
    known = training_labels(labels, "quality")
    prior = prior_of(known)
    if not prior or prior >= 1:
        return None
    rows = texts(docs)
    good = sampled(known.where("label = 1").join(rows.select("doc_id").distinct(), "doc_id"), sample)
    any_ = sampled(rows.select("doc_id").where("doc_id is not null").distinct(), sample, seed=12)
    chosen = saved(
        good.select("doc_id", F.lit(True).alias("good")).unionByName(any_.select("doc_id", F.lit(False).alias("good"))),
        "sample",
    )

    @F.pandas_udf("array<float>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([form(t) for t in batch])

    # The sample's size is bounded by the parameter, so its ids may go to every task.
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", described("text").alias("form"))
    table = found.dropDuplicates(["doc_id", "good"]).orderBy("doc_id", "good").toPandas()
    mark = table["good"].to_numpy(dtype=bool)
    if not mark.any() or mark.all():
        return None
    values = matrix(table["form"])
    return fit_pu(values[mark], values[~mark], prior)


def score_of(model: Network | None, text: Column) -> Column:
    """The score of a whole text as a column: the probability of class 1, or 1 without a model."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(matrix([form(t) for t in batch])) if len(batch) else [], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """Score every whole text of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Only training rows with label 1 are learned from, next to unlabelled texts; the training labels'
    share of ones is the class prior. At most ``sample`` rows of either kind are fitted on (those of
    the smallest hashes of their ids). A NULL text is empty. Repeated rows are scored alike. Without
    training labels of both classes nothing speaks for or against any text: all scores are 1.
    """
    model = fitted(docs, labels, sample)
    scored = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, as they are, whose texts score ``threshold`` or more."""
    return docs.where(score_of(fitted(docs, labels, sample), docs["text"]) >= threshold)
