"""A toxicity classifier: boosted trees over a few dense numbers, calibrated to probabilities.

The lexicon is learned: words and word beginnings that are far more frequent in toxic than in other
training texts. Half of the sample gives the lexicon, the other half the trees, so that the trees
see the lexicon's densities as they are on texts it was not made from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped, texts
from pulseline.llm.labelled import held_out, sampled, training_labels
from pulseline.llm.quality import matrix

# Labelled rows fitted on, and stems in the lexicon, at most. Lengths of word beginnings.
SAMPLE, STEMS = 16_000, 2_000
BEGINNINGS = (4, 5, 6)
# Words remembered by a task.
REMEMBERED = 300_000
# Words that address somebody, in the languages of the corpus.
ADDRESS = """
you your yours yourself u ur thou thee thy
du dich dir dein deine deinen deiner ihr euch euer eure
tu te toi ton ta tes vous votre vos
tú ti usted ustedes vosotros vuestro vuestra
""".split()
# Signs that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = ".,;:!?\"'()[]{}<>|-–—…*#%&"
INNER_SIGN = re.compile(r"^\w*[a-zA-Z]+[0-9@$!*#%.\-_]+[a-zA-Z]+\w*$")


def stems(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon entries."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]


def learn_lexicon(rows: DataFrame, most: int = STEMS, least: int = 4, odds: float = 6.0) -> dict[str, float]:
    """Stems of labelled texts (``text``, ``label``) with the log of how much likelier toxic texts have them."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "))
    word = rows.select("label", F.explode(words).alias("w")).where("w <> ''")
    entries = F.array(F.col("w"), *[F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("-"))) for n in BEGINNINGS])
    counted = (
        word.select("label", F.explode(F.array_compact(entries)).alias("stem"))
        .groupBy("stem")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    )
    weight = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("other") + 0.5) / other)
    best = (
        counted.where(F.col("toxic") >= least)
        .withColumn("weight", weight)
        .where(F.col("weight") >= float(np.log(odds)))
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "stem")
        .limit(most)
    )
    return {r["stem"]: float(r["weight"]) for r in best.select("stem", "weight").collect()}


class Describer:
    """The dense numbers of a text; one per task."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known, self.address = lexicon, {}, set(ADDRESS)

    def _look(self, raw: str) -> tuple[float, float, int, int]:
        """Lexicon weight of a word as it stands, the weight that undoing a disguise adds, and two signs."""
        word = raw.strip(EDGES).lower()
        weight = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0
        hidden = 0.0
        plain = re.sub(r"[^\w]|_", "", raw.lower().translate(DISGUISES))
        if weight == 0 and plain != word:
            hidden = max((self.lexicon.get(s, 0.0) for s in stems(plain)), default=0.0) if plain else 0.0
        return weight, hidden, int(word in self.address), int(bool(INNER_SIGN.match(raw.strip(EDGES))))

    def describe(self, text: str) -> list[float]:
        words = text.split()
        n = max(len(words), 1)
        known = self.known
        for w in set(words):
            if w not in known:
                if len(known) > REMEMBERED:
                    known.clear()
                known[w] = self._look(w)
        table = [known[w] if w in known else self._look(w) for w in words]
        looks = np.array(table, dtype=np.float64).reshape(-1, 4)
        weights, hidden, address, signs = looks.T if len(looks) else np.zeros((4, 0))
        hits = np.flatnonzero(weights > 0)
        spoken = np.flatnonzero(address > 0)
        near = 0
        if len(hits) and len(spoken):
            after = np.searchsorted(spoken, hits)
            right = spoken[np.minimum(after, len(spoken) - 1)]
            left = spoken[np.maximum(after - 1, 0)]
            near = int((np.minimum(np.abs(right - hits), np.abs(left - hits)) <= 5).sum())
        densest = 0
        if len(hits):
            densest = int((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
        single = np.fromiter((len(w) == 1 for w in words), dtype=bool, count=len(words))
        spaced = int((single[2:] & single[1:-1] & single[:-2]).sum()) if len(words) > 2 else 0
        upper = sum(map(str.isupper, text))
        letters = max(sum(map(str.isalpha, text)), 1)
        return [
            len(hits) / n,
            weights.sum() / n,
            weights.max() if len(weights) else 0.0,
            np.log1p(len(hits)),
            float(len({words[i].lower() for i in hits})),
            float(densest),
            hidden.sum() / n,
            float((hidden > 0).sum()),
            near / n,
            len(spoken) / n,
            upper / letters,
            text.count("!") / n,
            text.count("?") / n,
            sum(text.count(c) for c in ".,;:") / n,
            signs.sum() / n,
            spaced / n,
            np.log1p(len(words)),
        ]


class Trees:
    """Gradient boosting of depth-limited trees on binned features, with the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Cuts between the values that occur: most are zero, so zero alone must not use up the cuts.
        self.cuts = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            spread = np.quantile(values, levels) if len(values) > 1 else values
            usual = np.quantile(x[:, j], levels)
            self.cuts.append(np.unique(np.r_[spread, usual]))
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.start)
        width = max(len(c) for c in self.cuts) + 1
        offsets = np.arange(b.shape[1]) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            splits = []
            for _ in range(self.depth):
                nodes = 1 << len(splits)
                at = (node[:, None] * b.shape[1] * width + offsets + b).ravel()
                size = nodes * b.shape[1] * width
                gs = np.bincount(at, np.repeat(g, b.shape[1]), size).reshape(nodes, b.shape[1], width)
                hs = np.bincount(at, np.repeat(h, b.shape[1]), size).reshape(nodes, b.shape[1], width)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                feature, cut = best // width, best % width
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            f = f + value[node]
            self.trees.append((splits, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            f = f + value[node]
        return f


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of ``raw`` nearest to ``y``, as knots; by pooling adjacent violators."""
    points, where = np.unique(raw, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last point
    for m, w, x in zip(mean, weight, points):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] for b in blocks for _ in range(2)])
    return xs, ys


class Model:
    def __init__(self, trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.trees, self.knots = trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, folds: int = 4) -> Model:
    """Trees on all rows; calibrated on the scores of rows that the scoring trees had not seen."""
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        if 0 < y[fold != k].sum() < (fold != k).sum():
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(Trees().fit(x, y), isotonic(out, y))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """Score every whole text of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Learned from at most ``sample`` labelled rows outside the held-out fold (those of the smallest
    hashes of their ids): half for the lexicon, half for trees and calibration. A NULL text is
    empty. Repeated rows are scored alike; of rows with one id, the smallest is learned from. Without labels of both classes the score is the share of
    toxic training labels, or 0 if there are none.
    """
    shipped(__name__)
    known = saved(sampled(training_labels(labels, "toxic"), sample), "toxic-labels")
    rows = texts(docs)
    share = known.agg(F.avg("label")).first()[0] or 0.0
    marked = out = rows.select("doc_id").withColumn("held_out", held_out(F.col("doc_id")))
    scored = marked.withColumn("score", F.lit(float(share)))
    if 0 < share < 1:
        # The sample's size is bounded by the parameter, so its texts are found without a shuffle.
        labelled = rows.join(F.broadcast(known), "doc_id")
        half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
        # However often an id is repeated, it is learned from once.
        once = labelled.where(half == 0).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        lexicon = learn_lexicon(saved(once.select("text", "label"), "lexicon-texts"))

        @F.pandas_udf("array<float>")
        def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            describer = Describer(lexicon)
            for batch in batches:
                yield pd.Series([describer.describe(t) for t in batch])

        table = saved(rows.select("doc_id", described("text").alias("form")), "toxic-form")
        training = table.join(F.broadcast(known.where(half == 1)), "doc_id")
        training = training.groupBy("doc_id", "label").agg(F.min("form").alias("form")).orderBy("doc_id").toPandas()
        if 0 < training["label"].sum() < len(training):
            model = fit(matrix(training["form"]), training["label"].to_numpy(dtype=float))

            @F.pandas_udf("double")
            def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for batch in batches:
                    yield pd.Series(model.score(matrix(batch)) if len(batch) else [], dtype="float64")

            out = table.withColumn("held_out", held_out(F.col("doc_id")))
            scored = out.select("doc_id", "held_out", score("form").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
