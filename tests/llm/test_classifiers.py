import random

import numpy as np
from plain import ODD, deduplicated, near_copies, normal, table_of

import corpus_pipeline
from pulseline.llm import quality, suffixes, toxicity
from pulseline.llm.common import table
from pulseline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def judged(spark, name, label):
    got = QUERIES[name](spark, FOLDER).toPandas()
    labels = table(spark, FOLDER, "labels").toPandas()
    docs = table(spark, FOLDER, "documents")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    return held["predicted"].to_numpy(), held[label].to_numpy(), got


def test_quality_query(spark):
    predicted, label, got = judged(spark, "op7_quality", "quality")
    assert (predicted == label).mean() > 0.95
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_toxicity_query(spark):
    predicted, label, got = judged(spark, "op9_toxicity", "toxic")
    assert (predicted == label).mean() > 0.9
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_scores_of_odd_rows(spark):
    docs = table_of(spark, ODD)
    none = labels_of(spark, [(None, None, None, "x"), (1, None, None, "x"), (99, 1, 1, "x"), (99, 1, 1, "x")])
    for labels in (none, none.limit(0)):
        good = quality.quality_scores(docs, labels)
        bad = toxicity.toxicity_scores(docs, labels)
        assert good.count() == bad.count() == len(ODD)
        assert good.where("score = 1 and predicted = 1").count() == len(ODD)
        assert bad.where("score between 0 and 1").count() == len(ODD)
        assert quality.good_documents(docs, labels).columns == docs.columns
    some = labels_of(spark, [(i, i % 2, 1 - i % 2, "x") for i in range(10)])
    for out in (quality.quality_scores(docs, some), toxicity.toxicity_scores(docs, some)):
        assert out.where("score between 0 and 1 and predicted is not null").count() == len(ODD)
    assert quality.quality_scores(table_of(spark, []), some).count() == 0
    assert toxicity.toxicity_scores(table_of(spark, []), some).count() == 0


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    docs = table(spark, FOLDER, "documents").limit(400).select("doc_id", "text").localCheckpoint()
    labels = table(spark, FOLDER, "labels")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    hot = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").orderBy("doc_id").limit(4)
    copies = hot.crossJoin(spark.range(100)).drop("id")
    got = toxicity.toxicity_scores(docs.unionByName(copies), labels).collect()
    assert len(got) == 800 and seen[0] == seen[1]
    assert {(r["doc_id"], r["score"]) for r in got} == set(plain.items())


def test_held_out_labels_are_not_learned_from(spark):
    from pulseline.llm.labelled import held_out, training_labels

    labels = labels_of(spark, [(i, 1, 0, "x") for i in range(200)])
    kept = {r["doc_id"] for r in training_labels(labels, "quality").collect()}
    out = {r[0] for r in labels.where(held_out(labels["doc_id"])).select("doc_id").collect()}
    assert kept | out == set(range(200)) and not kept & out and len(out) > 20


def test_positive_unlabelled_learning():
    r = np.random.default_rng(1)
    good, bad = r.normal(1.5, 1, (4_000, 3)), r.normal(-1.5, 1, (4_000, 3))
    unlabelled = np.vstack([good[2_000:3_400], bad[:600]])
    model = quality.fit_pu(good[:2_000], unlabelled, prior=0.7)
    assert (model.score(good[3_400:]) > 0.5).mean() > 0.97
    assert (model.score(bad[600:]) < 0.5).mean() > 0.97


def test_trees_and_calibration():
    r = np.random.default_rng(2)
    x = r.normal(size=(6_000, 4))
    chance = np.where((x[:, 0] > 0.3) & (x[:, 1] < 0.5), 0.9, 0.1)
    y = (r.random(6_000) < chance).astype(float)
    model = toxicity.fit(x[:4_000], y[:4_000])
    got = model.score(x[4_000:])
    assert np.abs(got - chance[4_000:]).mean() < 0.05


def test_isotonic_is_the_best_rising_fit():
    xs, ys = toxicity.isotonic(np.array([3.0, 1, 2, 2, 5, 4]), np.array([1.0, 0, 1, 0, 1, 0]))
    at = lambda v: float(np.interp(v, xs, ys))
    assert [round(at(v), 3) for v in (1, 2, 3, 4, 5)] == [0, 0.5, 0.5, 0.5, 1]


def test_describing_disguised_words():
    lexicon = {"idiot": 5.0, "lowei-": 4.0}
    d = toxicity.Describer(lexicon)
    plain, disguised, other = (d.describe(t) for t in ("You are an idiot.", "you are an 1d10t", "you are fine"))
    assert plain[0] == 0.25 and plain[8] == 0.25 and disguised[0] == 0 and disguised[6] > 0 and not any(other[:9])
    assert d.describe("loweixyz")[0] == 1 and len(d.describe("")) == len(plain)


def test_pipeline_against_plain_python(spark, monkeypatch):
    """The stages' decisions, made again by plain code (the classifier's are taken from its query)."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in table(spark, folder, "documents").collect()}
    good = {r["doc_id"] for r in QUERIES["op7_quality"](spark, folder).where("predicted = 1").collect()}
    rows = [(i, docs[i]["text"]) for i in sorted(good)]
    rows = [(i, t) for i, t in rows if near_copies(rows)[i][0] == i]
    seen, left = set(), []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        if kept or not t:
            left.append((i, "".join(kept)))
    items = [normal(r["text"]) for r in table(spark, folder, "benchmark").collect()]
    clean = {i: t for i, t in left if not any(x in normal(t) for x in items)}
    got = corpus_pipeline.run(spark, folder).collect()
    pieces = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], "") + r["text"]
    assert pieces == clean
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for own in by_bin.values():
        assert sum(r["length"] + 1 for r in own) + own[0]["room_left"] == 16_384
        assert len({r["source"] for r in own}) == len(own)


def test_stages_keep_the_columns(spark):
    from pulseline.llm.common import saved

    folder = "/root/testdata/sf0.001"
    docs = table_of(spark, [*ODD, *[(100 + i, f"Some words of text number {i}, and a few more of them.", "s") for i in range(30)]])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
