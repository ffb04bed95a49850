"""Importance resampling, collocations and quality rules, against SQL and plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from checks import database, rows_of
from plain import ODD, table_of

from pulseline.llm import collocations, importance, quality_rules
from pulseline.llm.queries import QUERIES

# Cases where words, pieces, lines, windows and repeats matter.
CASES = [
    (1, "The cat. The cat sat; the CAT sat\ton the mat!\nThe cat sat", "a"),
    (2, "a a a a a a a a a a", "a"),
    (2, "a a a a a a a a a a", "a"),
    (3, "# ** $% one|two <b> & three four five six seven eight nine ten eleven", "b"),
    (4, "one two three\none two three\n\n \none two three\n- four\n* five…\nsix...", "b"),
    (5, "ÉTÉ été l'été Ünder 😀 naïve\x0bpage\x0cbreak\r\nend 0x1F Straße", "c"),
    (6, " ".join(f"w{i % 7}" for i in range(60)), "c"),
    (7, "WHY!! NOT?? NOW!! YES!! THE END!! AND SO!! ON!! AND ON!! AGAIN!! STOP!!", "c"),
    (8, " non breaking spaces are parts of words here one two three four five six", "d"),
]


def folder_of(spark, tmp_path, rows, benchmark=("the cat sat on the mat", None, "")):
    table_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(benchmark)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op11_importance", "op12_collocations", "op13_quality_rules"])
def test_query_against_sql(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert len(got) and rows_of(got) == rows_of(database(folder).execute(QUERIES[name].sql).df())


# ---- importance


def words_of(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in plain).split(" ")


def runs_of(text, longest):
    words = [w for w in words_of(text) if w]
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, buckets, longest, least_words, percent, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, _ in docs:
        s.update(map(bucket, runs_of(text, longest)))
    for text in target:
        t.update(map(bucket, runs_of(text, longest)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text, _ in docs:
        found = runs_of(text, longest)
        weight = sum(gain(bucket(r)) for r in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(runs_of(text, 1)) >= least_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_is_the_definition(spark, longest):
    rng = random.Random(longest)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)] + ["É", "ñandú", "IO"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60))), "s") for i in range(120)] + ODD
    target = [" ".join(rng.choice(vocab[:40]) for _ in range(30)) for _ in range(10)] + [None, ""]
    wanted = resampled(docs, target, 500, longest, 5, 30, 9)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    rows = table_of(spark, docs)
    # The head changes no result: none, some words, all of them.
    for words, pairs in ((0, 0), (20, 30), (10_000, 10_000)):
        head = importance.head_of(rows, longest, words, pairs, 500)
        assert len(head.states) <= words and len(head.pairs) <= pairs
        got = importance.resampled(rows, bench, 500, longest, 5, 30, 9, head)
        assert sorted((tuple(r) for r in got.collect()), key=str) == wanted


def test_head_is_the_most_frequent(spark):
    rows = table_of(spark, [(1, "b b b a a c", "s"), (2, "A b a b", "s"), (3, "x" * 100 + " " + "x" * 100, "s")])
    assert importance.head_of(rows, 2, 2, 1, 100).states == {b"b": zlib.crc32(b"b"), b"a": zlib.crc32(b"a")}
    twice = {(a, b): zlib.crc32(a + b" " + b) % 100 for a, b in ((b"b", b"b"), (b"a", b"b"), (b"b", b"a"))}
    assert importance.head_of(rows, 2, 2, 3, 100).pairs == twice
    # Keys that come up equally often are in the head together or not at all.
    assert importance.head_of(rows, 2, 2, 2, 100).pairs == {}


def test_resampling_of_odd_tables(spark):
    none = table_of(spark, [])
    bench = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(none, bench).count() == 0
    got = importance.resampled(table_of(spark, ODD), none.select("text"), percent=100, least_words=0)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, len(ODD) + 1))
    short = importance.resampled(table_of(spark, ODD[:5]), bench).collect()
    assert [r["rank"] for r in short] == [None] * 5


def test_equal_rows_share_no_task_by_force(spark):
    rows = spark.range(3_000).selectExpr("1L as doc_id", "25L as n_words", "7L as score")
    got = importance.ranked(rows, rows["n_words"] >= 20, 50)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, 1_501))


# ---- collocations


def collocated(docs, longest, least, covered, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            plain = plain.replace(c, "\n")
        for piece in plain.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    wanted = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in wanted.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i : i + k])
                inside[key] = max(inside[key], a)
    out = {}
    for (lang, p), a in wanted.items():
        if 100 * inside[lang, p] >= covered * a:
            continue
        cuts = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, (l, r) = min((2_000_000 * a // (l + r), k, (l, r)) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def langs(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "clash") for lang, t in rows], "lang string, text string, n int, phrase string")


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in collocations.collocations(langs(spark, rows), **how).collect())


@pytest.mark.parametrize("seed", range(3))
def test_collocations_are_the_definition(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed == 1:  # short stretches, nearly every prefix wide
        monkeypatch.setattr(collocations, "CHUNK", 300)
        monkeypatch.setattr(collocations, "WIDE", 10)
    if seed == 2:  # a filter that lets most pass
        monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    vocab = ["the", "of", "New", "york", "é", "ñ x", "city", "😀", "w1", "w2", "w3"]
    fixed = ["new york city", "the end of the world.", "The end of", "a a a a a"]
    rows = []
    for _ in range(150):
        words = [rng.choice(fixed if rng.random() < 0.3 else vocab) + rng.choice(["", "", "", ",", "\t", "\n", " "]) for _ in range(30)]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    rows += [("en", None), (None, ""), ("fr", "one"), ("fr", " \t\n.,")]
    for how in ({"least": 8, "longest": 4, "covered": 80, "top": 50}, {"least": 5, "longest": 3, "covered": 100, "top": 2_000}):
        assert mined(spark, rows, **how) == collocated(rows, how["longest"], how["least"], how["covered"], how["top"])


def test_stripes_add_up(spark):
    rows = langs(spark, [("en", "a b a b a c. a"), ("en", "a b")]).selectExpr("lang", "cast(text as binary) as text")
    first = collocations.stripes(rows, 1, 2).collect()
    assert {(e["word"], e["n"]) for r in first for e in r["next"]} == {("a", 5), ("b", 3)}
    bits = collocations._broadcast(spark, collocations.extensions(collocations.stripes(rows, 1, 2)))
    second = {r["prefix"]: (r["total"], [tuple(e) for e in r["next"]]) for r in collocations.stripes(rows, 2, 2, bits).collect()}
    assert second == {"a": (5, [("b", 3)]), "b": (3, [("a", 2)])}


def test_stripes_are_taken_apart_once(spark):
    rows = langs(spark, [("en", "a b a b")]).selectExpr("lang", "cast(text as binary) as text")
    plan = collocations.stripes(rows, 1, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("split(") == 1


def test_stripes_of_what_goes_on_rarely_are_not_passed_on(spark, monkeypatch):
    """"a b" comes up often, but nothing that starts with "b" does: no stripe of three words can hold a frequent phrase."""
    passed, saved = {}, collocations.saved

    def counted(df, name):
        out = saved(df, name)
        passed[name] = out.count()
        return out

    monkeypatch.setattr(collocations, "saved", counted)
    rows = [("en", f"a b x{i}.") for i in range(40)]
    how = {"longest": 4, "least": 30, "covered": 80, "top": 10}
    assert mined(spark, rows, **how) == collocated(rows, *how.values()) == [("en", 1, "a b", 40, 40, 40, 120, 1_000_000)]
    assert passed["stripes2"] == 1 and passed["stripes3"] == passed["stripes4"] == 0


def test_stripes_without_totals_have_the_same_frequent_entries(spark):
    rng = random.Random(5)
    texts = [("en", " ".join(rng.choice(["a", "b", "c", f"x{i}", "d."]) for _ in range(30))) for i in range(60)]
    rows = langs(spark, texts).selectExpr("lang", "cast(text as binary) as text")
    bits = collocations._broadcast(spark, collocations.extensions(collocations.stripes(rows, 1, 20)))
    with_, without = (collocations.stripes(rows, 2, 20, bits, totals=t) for t in (True, False))
    found = [sorted(tuple(r) for r in collocations.extensions(s).collect()) for s in (with_, without)]
    assert found[0] == found[1] and len(found[0]) > 5 and without.count() < with_.count()


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 20)
    text = b"one two three. four five six seven eight nine ten eleven, twelve"
    cut = list(collocations.pieces([text]))
    assert b"\n".join(cut) == text.replace(b".", b"\n").replace(b",", b"\n") and len(cut) > 1


@pytest.mark.parametrize("one_hash", [False, True])
def test_words_of_a_stretch(monkeypatch, one_hash):
    """Numbers stand for the words in order, breaks for pieces; also where all words have one hash."""
    if one_hash:
        monkeypatch.setattr(collocations, "run_hash", lambda before, word: before * 0)
    rng = random.Random(8)
    words = ["a", "b", "ab", "ba", "a\0", "\0a", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 40, "é", "x" * 15 + "y"]
    for trial in range(30):
        pieces = [[rng.choice(words).encode() for _ in range(rng.randrange(5))] for _ in range(rng.randrange(6))]
        data = b"\n".join(b" ".join(p) + b" " * rng.randrange(3) for p in pieces)
        code, vocab = collocations.coded(data)
        back = [[]]
        for k in code.tolist():
            if k < 0:
                back.append([])
            else:
                back[-1].append(vocab[k])
        assert [p for p in back if p] == [p for p in pieces if p] and len(set(vocab)) == len(vocab)


def test_score_beyond_64_bits(spark):
    big = 1 << 62
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    got = row.selectExpr(collocations.SCORE.format(a="a", l="l", r="r") + " as s").first()["s"]
    assert got == 2_000_000 * big // (2 * big + 1)


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "a b c"), (None, None)]) == []


# ---- rules


def test_rules_of_odd_texts_against_sql(spark, tmp_path):
    folder = folder_of(spark, tmp_path, CASES + ODD)
    con = database("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = QUERIES["op13_quality_rules"](spark, folder).toPandas()
    assert len(got) == len(CASES + ODD)
    assert rows_of(got) == rows_of(con.execute(quality_rules.sql()).df())


def test_measures_are_the_definition(spark):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table_of(spark, CASES)).collect()}
    for i, text, _ in CASES:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        again = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[i]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(again)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(again) > 20 * len(words))
    assert got[7]["broken"] == ["doubled_marks", "capitals"] and not got[7]["kept"]
    assert got[8]["kept"] and got[8]["broken"] == []


def test_a_table_of_other_thresholds(spark):
    rows = table_of(spark, [(1, "one two three", "s"), (2, "one two three four", "s"), (3, None, "s")])
    rule = quality_rules.Rule("words", "n_words", "one", least=100, most=300)
    got = quality_rules.quality_rules(rows, [rule], []).orderBy("doc_id").collect()
    assert [(r["kept"], r["broken"]) for r in got] == [(True, []), (False, ["words"]), (False, ["words"])]
    assert quality_rules.quality_rules(rows.limit(0)).count() == 0


def test_rules_use_no_user_functions(spark):
    plan = quality_rules.quality_rules(table_of(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_collocation_stretches_are_short():
    """What a task counts at once is bounded by 4 MB of text, wherever its texts end, and no word is lost."""
    texts = [b"some words of a text\n" * 50_000] * 9
    parts = list(collocations.pieces(texts))
    assert max(map(len, parts)) <= 4 << 20
    assert b"\n".join(parts) == b"\n".join(texts)
