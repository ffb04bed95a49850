"""A Jaccard join on word n-grams, by chosen paths.

Texts with the same set of n-grams are one class. Each class has a signature: for each of a number
of hash functions its smallest token. A tree splits the classes: a node samples two of the hash
functions, and a class goes to the child that its token under each of them names; so alike classes
meet often. Nodes of few classes are leaves: their pairs are looked at. Large nodes split on. A
node that hardly shrinks when it splits holds classes that are alike, and is a leaf too. With two
children per node a pair of similarity s survives a tree of any depth with probability x, the
solution of x = 1 - (1 - s x)^2; trees are repeated until the target recall is reached.

Pairs that look alike by signature, and dense leaves, give candidate groups. In each, all pairs are
compared by their whole sets, block against block, so no group has to fit into one task, and links
are counted where they are found, so no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped, texts
from pulseline.llm.components import components
from pulseline.llm.order import distinct
from pulseline.llm.rolling import Stretches, mixed

# Words hashed at a time.
TOGETHER = 100_000


@dataclass(frozen=True)
class Rules:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999
    # Hash functions in a signature, and how far below the similarity its estimate may lie.
    functions: int = 48
    slack: float = 0.25
    # Classes in a leaf; share of a node that a child must keep for the node to count as dense.
    leaf: int = 40
    dense: float = 0.6
    depth: int = 16
    # Classes, and tokens in all, in a block.
    block: int = 256
    block_tokens: int = 1_000_000
    seed: int = 17

    def trees(self) -> int:
        """Trees needed for the target recall of a pair that is just similar enough."""
        s, x = self.similarity, 1.0
        for _ in range(self.depth):
            x = 1 - (1 - s * x) ** 2
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - x))) if x < 1 else 1


def shingles(text: str, words: int) -> np.ndarray:
    """The set of n-grams of white-space separated words as sorted hashes; of fewer words, all in one."""
    parts = text.split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    found, n = [], max(len(parts) - words + 1, 1)
    for i in range(0, n, TOGETHER):
        raw = np.frombuffer(" ".join(parts[i : min(i + TOGETHER, n) + words - 1]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        space = np.flatnonzero(raw == 32)
        first, after = np.r_[0, space + 1], np.r_[space, len(raw)]
        width = min(words, len(first))
        found.append(Stretches(raw)(first[: len(first) - width + 1], after[width - 1 :]))
    return np.unique(np.concatenate(found))


def signature(tokens: np.ndarray, functions: int, seed: int) -> np.ndarray:
    """For each hash function the smallest hash of a token, as a 32-bit number; -1 for an empty set."""
    if not len(tokens):
        return np.full(functions, -1, dtype=np.int32)
    turn = mixed(np.arange(1, 2 * functions + 1, dtype=np.uint64) + np.uint64(seed << 20))
    factor, shift = turn[:functions] | np.uint64(1), turn[functions:]
    least = np.full(functions, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(tokens), 4096):
        part = tokens[i : i + 4096, None]
        least = np.minimum(least, (part * factor + shift).min(0))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def digest(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set, from two sums over its tokens and its size."""
    one, two = tokens.sum(dtype=np.uint64), mixed(tokens + np.uint64(1)).sum(dtype=np.uint64)
    both = mixed(np.array([one], dtype=np.uint64)) * np.uint64(31) + two + np.uint64(len(tokens))
    return int(mixed(both).view(np.int64)[0])


def signed(docs: DataFrame, rules: Rules) -> DataFrame:
    """``doc_id``, ``cls`` (the same for equal sets), ``n`` tokens and signature of every whole text."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingles(text, rules.words)
                rows.append((digest(tokens), len(tokens), signature(tokens, rules.functions, rules.seed)))
            out = pd.DataFrame(rows, columns=["cls", "n", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out.astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(look, "doc_id bigint, cls bigint, n bigint, sig array<int>")


def _leaves(classes: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows (``node``, ``cls``) of the leaves with few classes, and of those that are dense."""
    t, small, dense = rules.functions, [], []

    def children(node):
        """The two children of a node, as the hash functions that it samples send a class there."""
        one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(t)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(t - 1)).cast("int"), F.lit(t))
        return [F.xxhash64(node, F.lit(k), F.get("sig", at)) for k, at in ((1, one), (2, two))]

    roots = [F.lit(rules.seed * 1000 + tree).cast("bigint") for tree in range(rules.trees())]
    level = classes.where("n > 0").select(
        "cls",
        F.explode(F.array(*[c for root in roots for c in children(root)])).alias("node"),
        F.lit(None).cast("bigint").alias("was"),
    )
    for depth in range(1, rules.depth + 1):
        level = saved(level, "paths")
        sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.max("was").alias("was")).where("size > 1")
        kept = F.col("size") >= rules.dense * F.col("was")
        sizes = sizes.withColumn(
            "kind",
            F.when(F.col("size") <= rules.leaf, "small")
            .when(F.coalesce(kept, F.lit(False)) | F.lit(depth == rules.depth), "dense")
            .otherwise("split"),
        )
        placed = saved(level.drop("was").join(sizes.select("node", "size", "kind"), "node"), "nodes")
        small.append(placed.where("kind = 'small'").select("node", "cls"))
        dense.append(placed.where("kind = 'dense'").select("node", "cls"))
        rest = placed.where("kind = 'split'")
        if not rest.limit(1).count():
            break
        level = rest.join(classes.select("cls", "sig"), "cls").select(
            "cls", F.explode(F.array(*children(F.col("node")))).alias("node"), F.col("size").alias("was")
        )

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return all_of(small), all_of(dense)


def _candidates(classes: DataFrame, rules: Rules) -> DataFrame:
    """Edges ``a``, ``b`` between classes that may be similar; they hold every such group together."""
    small, dense = _leaves(classes, rules)
    # At most ``rules.leaf`` classes in a list.
    together = small.groupBy("node").agg(F.sort_array(F.collect_list("cls")).alias("m"))
    pair = F.flatten(
        F.transform(
            "m",
            lambda x, i: F.transform(
                F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    pairs = together.select(F.inline(pair)).distinct()
    sig = classes.select("cls", "sig")
    both = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b"
    )
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    alike = both.where(same >= (rules.similarity - rules.slack) * rules.functions).select("a", "b")
    hub = dense.groupBy("node").agg(F.min("cls").alias("a"))
    star = dense.join(hub, "node").select("a", F.col("cls").alias("b")).where("a <> b")
    return alike.unionByName(star)


def _union(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member of each one's component."""
    label, n = np.arange(len(linked)), len(linked)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compare(sets: list[np.ndarray], limit: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of ``limit`` or more, as a matrix without its diagonal."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    token, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    inside = shared[where]
    owner, column = owner[inside], column[where[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        held = np.zeros((n, 4096), dtype=np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= limit * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _verified(grouped: DataFrame, rules: Rules) -> DataFrame:
    """Rows (``cls``, ``links``, ``root``) from comparing the sets in each pair of blocks of a group."""
    sizes = grouped.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    blocks = F.greatest(
        F.ceil(F.col("members") / rules.block), F.ceil(F.col("tokens") / rules.block_tokens)
    ).cast("int")
    placed = grouped.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn(
        "own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("root").alias("grp"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "cls",
        "copies",
        "tokens",
    )
    limit = rules.similarity

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def settled() -> list[tuple]:
            sets = [np.asarray(r[3], dtype=np.int64).view(np.uint64) for r in held]
            linked = _compare(sets, limit)
            own = np.array([r[0] for r in held])
            i, j = held[0][4], held[0][5]
            if i != j:  # pairs inside a block are the business of that block alone
                linked &= own[:, None] != own[None, :]
            links = linked @ np.array([r[2] for r in held], dtype=np.int64)
            label = _union(linked)
            return [(held[k][1], int(links[k]), held[label[k]][1]) for k in range(len(held))]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["cls", "links", "root"])

        now, out = None, []
        for batch in batches:
            columns = ("grp", "i", "j", "own", "cls", "copies", "tokens")
            for g, i, j, own, cls, copies, tokens in zip(*(batch[c] for c in columns)):
                if (g, i, j) != now:
                    if len(held) > 1:
                        out += settled()
                    now, held = (g, i, j), []
                held.append((own, cls, copies, tokens, i, j))
                if len(out) > 5000:
                    yield frame(out)
                    out = []
        if len(held) > 1:
            out += settled()
        if out:
            yield frame(out)

    return (
        met.repartition("grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j")
        .mapInPandas(compare, "cls bigint, links bigint, root bigint")
    )


def similar_classes(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Near duplicates among whole texts: ``doc_id``, ``class_id``, ``n_links``, one row per row of ``docs``.

    Two texts are linked if their sets of ``rules.words`` successive words have a Jaccard similarity
    of ``rules.similarity`` or more. ``n_links`` counts the linked rows (copies included), and
    ``class_id`` is the smallest ``doc_id`` that links lead to (NULL only if none has an id). Texts
    with fewer words are one n-gram. Texts without words, or NULL, are copies of each other and
    linked to nothing else. Repeated rows are copies.

    Similar pairs of different texts are found with a probability of ``rules.recall`` at least.
    Pairs that are found, and all pairs of the groups they form, are compared exactly.
    """
    for name in ("rolling", "jaccard"):
        shipped(f"pulseline.llm.{name}")
    rows = saved(signed(docs, rules), "signed")
    classes = saved(
        rows.groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"),
            F.max("n").alias("n"),
            F.max("sig").alias("sig"),
        ),
        "classes",
    )
    groups = saved(components(_candidates(classes, rules)), "groups")
    # The whole sets of the grouped classes, each once, from a document that has it.
    wanted = groups.join(
        classes.select(F.col("cls").alias("node"), "doc_id", "copies", "n"), "node"
    ).withColumnRenamed("node", "cls")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, rules.words) for t in batch["text"]]
            true = np.array([digest(s) == c for s, c in zip(found, batch["cls"])], dtype=bool)
            out = batch.drop(columns="text").assign(tokens=[s.view(np.int64) for s in found])
            yield out[true]

    # Ids that are NULL would not join, so they are told apart by a column of their own.
    known = lambda df: df.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}).drop("doc_id")
    held = known(texts(docs)).join(known(wanted), ["id", "no_id"]).select("cls", "root", "copies", "n", "text")
    grouped = held.mapInPandas(sets, "cls bigint, root bigint, copies bigint, n bigint, tokens array<bigint>")
    grouped = saved(grouped.dropDuplicates(["cls"]), "sets")
    found = saved(_verified(grouped, rules), "links")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    described = (
        classes.select("cls", "doc_id", "copies")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .join(links, "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    first = described.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_class = described.join(first, "root").select(
        "cls", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.select("doc_id", "cls").join(by_class, "cls").select("doc_id", "class_id", "n_links")


def with_classes(docs: DataFrame, name: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` with the number of their class of near duplicates as a column ``name``."""
    rows, order = distinct(docs)
    found = similar_classes(rows.select(F.col("uid").alias("doc_id"), "text"), rules)
    found = found.select(F.col("doc_id").alias("_uid"), F.col("class_id").alias(name))
    if order is None:
        own = docs.drop(name).withColumn("_uid", F.col("doc_id").cast("bigint"))
    else:
        key = {
            "_has_id": F.col("doc_id").isNotNull(),
            "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)),
            "_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
        uids = order.select(*[F.col(k[1:]).alias(k) for k in key], F.col("uid").alias("_uid"))
        own = docs.drop(name).withColumns(key).join(uids, [*key]).drop(*key)
    return own.join(found, "_uid").drop("_uid")


def one_of_each(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one with the smallest id stays.

    Of repeated rows (same id and text) one stays; where ids repeat or are NULL, texts that share an id
    are taken in the order of a hash.
    """
    rows, order = distinct(docs, docs.columns)
    found = similar_classes(rows.select(F.col("uid").alias("doc_id"), "text"), rules)
    lost = found.where("doc_id <> class_id").select(F.col("doc_id").alias("uid"))
    if order is None:
        return docs.join(lost.select(F.col("uid").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    return rows.join(lost, "uid", "left_anti").select(*[F.col("rest").getField(c).alias(c) for c in docs.columns])
