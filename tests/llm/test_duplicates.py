import random

import numpy as np
import pytest
from plain import LONG, ODD, best_fit, deduplicated, near_copies, normal, table_of

from pulseline.llm import components, decontaminate, jaccard, packing, suffixes
from pulseline.llm.common import table
from pulseline.llm.queries import QUERIES


def varied(seed, n_groups, copies, words=60):
    """Groups of texts with a few words changed, one large group, and a common passage."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=30))
    out = []
    for g in range(n_groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(copies if g else 12 * copies):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(words)] = r.choice(vocabulary)
            out.append(" ".join(own) + (f" {passage}" if r.random() < 0.4 else ""))
    r.shuffle(out)
    return [(i, t, "s") for i, t in enumerate(out)]


# ---- near copies


def test_jaccard_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    got = QUERIES["op8_jaccard"](spark, folder).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == near_copies([tuple(d) for d in docs])


@pytest.mark.parametrize("rules", [
    jaccard.Rules(),
    jaccard.Rules(leaf=3, block=5, recall=0.9999),
    jaccard.Rules(leaf=2, dense=2.0, depth=4, block_tokens=300, recall=0.9999),
])
def test_jaccard_of_crowded_groups(spark, rules):
    rows = varied(1, 12, 4)
    got = jaccard.similar_classes(table_of(spark, rows), rules).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == near_copies([x[:2] for x in rows])


def test_jaccard_of_odd_rows(spark):
    got = jaccard.similar_classes(table_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {(r["doc_id"], r["class_id"], r["n_links"]) for r in got}
    assert (4, 3, 1) in by_id and (9, 8, 2) in by_id and (7, 7, 0) in by_id and (6, 1, 4) in by_id
    assert jaccard.similar_classes(table_of(spark, [])).count() == 0
    kept = jaccard.one_of_each(table_of(spark, ODD))
    assert kept.columns == table_of(spark, ODD).columns
    texts = sorted((r["text"] or "").strip() for r in kept.collect())
    assert texts == sorted({(t or "").strip() for _, t, _ in ODD})
    plain = jaccard.one_of_each(table_of(spark, varied(2, 5, 3))).select("doc_id").collect()
    want = {root for root, _ in near_copies([x[:2] for x in varied(2, 5, 3)]).values()}
    assert {r[0] for r in plain} == want


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)]
    edges += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {(r["node"], r["root"]) for r in got} == {(x, find(x)) for x in root if x not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated strings


@pytest.mark.parametrize("symbols,n", [(2, 1), (2, 40), (3, 700), (60, 4_000)])
def test_suffix_order(symbols, n):
    r = random.Random(n)
    t = np.array([r.randrange(1, symbols + 1) for _ in range(n)] + [0])
    order = suffixes.suffix_order(t, 258, 10**6)
    listed = t.tolist()
    assert order.tolist() == sorted(range(n + 1), key=lambda i: listed[i:])


def test_suffix_order_of_repetitions():
    t = np.array([5, 6] * 300 + [5] * 200 + [5, 6, 7] * 100 + [0])
    listed = t.tolist()
    assert suffixes.suffix_order(t, 258, 10**6).tolist() == sorted(range(len(t)), key=lambda i: listed[i:])


def test_every_repeated_run_has_an_anchor():
    r = random.Random(9)
    raw = bytes(r.choice(b"ab ") for _ in range(3_000)) + b"a" * 500 + b"xy" * 300
    a = np.frombuffer(raw, dtype=np.uint8)
    h, _, own, place, left, right = suffixes.anchors(a, np.array([0, 1_000]), np.array([1_000, len(raw)]), 40, 8)
    covered = set()
    for o, p, lo, hi in zip(own, place, left, right):
        start = (0, 1_000)[o]
        covered |= {start + s for s in range(p - lo, p + hi - 39)}
    assert covered == set(range(0, 961)) | set(range(1_000, len(raw) - 39))


def check_removed(spark, rows, **options):
    got = suffixes.digests(suffixes.deduplicated(table_of(spark, rows), **options)).collect()
    want = deduplicated([x[:2] for x in sorted(rows)], options.get("length", 100))
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_suffix_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op5_suffixes"](spark, folder).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == deduplicated([tuple(d) for d in docs], 100)


@pytest.mark.parametrize("options", [{}, {"length": 40, "q": 8, "shard": 2_000}, {"length": 60, "q": 12, "crowd": 2}])
def test_repeats_of_crowded_groups(spark, options):
    rows = varied(3, 8, 3)
    rows += [(1_000, "ab" * 400, "s"), (1_001, "x" * 700 + "ab" * 200, "s"), (1_002, "é" * 300, "s"), (-5, rows[3][1], "s")]
    check_removed(spark, rows, **options)


def test_contexts_of_one_anchor_alike_in_half_their_hash(spark):
    letters = b"abcdefghijklmnopqrstuvwxyz"
    # The phrase's hash is so small that it is the anchor of nearly every run that holds it.
    phrase = b"crdisiitnpyxjttearxu"

    def text(seed):
        r = random.Random(seed)
        return bytes(r.choices(letters, k=40)) + phrase + bytes(r.choices(letters, k=40))

    pairs = [(129156, 229368), (239841, 244145), (6249, 230378), (24804, 85583)]
    rows = [(seed, text(seed).decode(), "s") for pair in pairs for seed in pair]
    for a, b in pairs:
        raw = np.frombuffer(text(a) + text(b), dtype=np.uint8)
        h, content, *_ = suffixes.anchors(raw, np.array([0, 100]), np.array([100, 200]))
        assert h[0] == h[1] and content[0] != content[1] and content[0] >> 32 == content[1] >> 32
    check_removed(spark, rows)


def test_repeats_of_odd_rows(spark):
    got = suffixes.deduplicated(table_of(spark, ODD), carry=["source"]).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    size = len(LONG.encode())
    assert by_id[3][0]["n_removed"] < size and by_id[4][0]["n_removed"] == size and by_id[4][0]["kept_text"] == ""
    assert by_id[7][0]["n_removed"] == 5_000 - 100 + 99 and by_id[4][0]["rest"]["source"] == "b"
    assert [r["n_removed"] for r in by_id[9]] == [len(ODD[-1][1].encode())] * 2
    assert suffixes.deduplicated(table_of(spark, [])).count() == 0


def test_carried_columns_have_any_names(spark):
    rows = table_of(spark, ODD)
    got = suffixes.deduplicated(rows, carry=rows.columns).collect()
    assert len(got) == len(ODD) and all(r["rest"]["_"] == "_" for r in got)


@pytest.mark.parametrize("length", [100, 200, 300, 400])
def test_strings_longer_than_a_byte_counts(spark, length):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(700))
    more = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(3)]
    rows = [(1, more[0] + shared, "a"), (2, shared + more[1], "a"), (3, shared[100:650] + more[2] + shared[:350], "a")]
    got = {r["doc_id"]: r for r in suffixes.digests(suffixes.deduplicated(table_of(spark, rows), length)).collect()}
    for doc_id, want in deduplicated([r[:2] for r in rows], length).items():
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
    with pytest.raises(ValueError):
        suffixes.deduplicated(table_of(spark, rows), 1 << 16)


def test_whole_characters_stay():
    raw = "aéé😀b".encode()
    assert suffixes._whole_characters(raw, [(2, 4)]) == []
    assert suffixes._whole_characters(raw, [(2, 8)]) == [(3, 5)]
    assert suffixes._whole_characters(raw, [(0, len(raw))]) == [(0, len(raw))]


# ---- benchmark passages


def test_benchmark_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    items = table(spark, folder, "benchmark").collect()
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op10_decontamination"](spark, folder).collect()}
    inside = {i["item_id"]: normal(i["text"]) for i in items}
    want = {(d["doc_id"], k) for d in docs for t in [normal(d["text"])] for k, v in inside.items() if v in t}
    assert set(got) == want and want
    text = {d["doc_id"]: d["text"] for d in docs}
    for (doc_id, item_id), r in got.items():
        assert normal(text[doc_id][r["spans"][0]["start"] : r["spans"][-1]["end"]]) == inside[item_id]
        assert r["edits"] == 0


def edit(r, text, n):
    s = list(text)
    for _ in range(n):
        at = r.randrange(len(s))
        kind = r.random()
        if kind < 0.4:
            s[at] = r.choice("xyz")
        elif kind < 0.7:
            s.insert(at, r.choice("xyz"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def distance(pattern, text):
    """Fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages_against_full_alignment():
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "is", "kappa", "lambda"]
    say = lambda n: " ".join(r.choices(words, k=n))
    rules = decontaminate.Rules()
    items = [(i, say(r.randrange(8, 20))) for i in range(6)]
    index = decontaminate.Index(rules).build(items)
    for trial in range(60):
        i, text = items[trial % 6]
        doc = say(r.randrange(0, 15)) + " " + edit(r, text, trial % 15) + " " + say(r.randrange(0, 15))
        got = {m[1]: m[2] for m in index.matches([doc])}
        want = {}
        for w, (a, b) in enumerate(zip(index.start, index.end)):
            d = distance(index.text[a:b].tolist(), decontaminate.normal(doc)[0].tolist())
            if d <= index.budget[w]:
                k = index.items[index.owner[w]]
                want[k] = min(d, want.get(k, 99))
        assert got == want


def test_excerpts_cut_anywhere():
    """Every passage of a window and a step is found with all edits a window may have; 13 words are one."""
    r = random.Random(16)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8)))
    say = lambda n: [word() for _ in range(n)]
    rules = decontaminate.Rules()
    items = [(i, " ".join(say(r.randrange(14, 60)))) for i in range(40)]
    index = decontaminate.Index(rules).build(items)
    k = rules.edits(rules.window)
    docs, want = [], []
    around = lambda passage: docs.append(" ".join([*say(r.randrange(9)), passage, *say(r.randrange(9))]))
    for trial in range(400):
        i, text = items[trial % len(items)]
        length = min(rules.window + rules.step - 1, len(text))
        cut = r.randrange(len(text) - length + 1)
        # A cut in a word leaves no space beside it, as edits leave none.
        around(edit(r, text[cut : cut + length], trial % (k + 1)).strip())
        want.append(i)
    for i, text in items:
        words = text.split()
        cut = r.randrange(len(words) - 12)
        around(" ".join(words[cut : cut + 13]))
        around(" ".join(word()[:6] if j % 10 == 9 else w for j, w in enumerate(words)))
        want += [i, i]
    whole = [distance(decontaminate.normal(items[i][1])[0].tolist(), decontaminate.normal(d)[0].tolist()) for d, i in zip(docs[:20], want)]
    assert max(whole) > k
    got = {(m[0], m[1]): m[2] for m in index.matches(docs)}
    assert [x for x in enumerate(want) if x not in got] == []
    for d in range(0, len(docs), 16):
        for i in (want[d], want[d - 1]):
            own = [w for w, o in enumerate(index.owner) if index.items[o] == i]
            text = decontaminate.normal(docs[d])[0].tolist()
            near = [distance(index.text[index.start[w] : index.end[w]].tolist(), text) for w in own]
            assert got.get((d, i), k + 1) == min(*near, k + 1, k + 1)


def test_benchmark_with_odd_rows(spark):
    item = "A question that is long enough to be looked for in many a document of the corpus"
    items = spark.createDataFrame([(1, item), (1, item.upper()), (2, None), (3, "short"), (None, "z " * 60)], "item_id long, text string")
    docs = table_of(spark, [*ODD, (20, f"before {item.lower()}, after", "s"), (20, f"before {item.lower()}, after", "s"), (21, item[:20], "s")])
    for chars in (2_000_000, 60):
        got = decontaminate.benchmark_matches(docs, items, block_chars=chars).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(20, 1)] * 4
        clean = decontaminate.clean_documents(docs, items, block_chars=chars)
        assert clean.count() == len(ODD) + 1 and clean.columns == docs.columns
    assert decontaminate.benchmark_matches(docs, items.limit(0)).count() == 0
    assert decontaminate.benchmark_matches(table_of(spark, []), items).count() == 0


def test_short_items_as_they_are(spark):
    rows = [(1, "Who wrote it?"), (2, "7"), (3, "ab"), (4, "\u4f60\u597d\u5417\uff1f"), (5, "?!"), (6, "Who wrote it"), (7, "x " * 14)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [
        (1, "So: who  WROTE it, then?", "s"), (2, "Who wrote item 77 of abc?", "s"), (3, "in 7 ab", "s"), (4, "\u8bf7\u95ee\u4f60\u597d\u5417\u6211", "s"),
        (5, "who wrote", "s"), (6, "it", "s"), (7, "who wrote it. Who wrote it", "s"), (8, "7", "s"),
    ]
    got = decontaminate.benchmark_matches(table_of(spark, docs), items).collect()
    want = [(1, 1), (1, 6), (3, 2), (3, 3), (4, 4), (7, 1), (7, 6), (8, 2)]
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert all(r["edits"] == 0 for r in got)
    spans = {(r["doc_id"], r["item_id"]): [tuple(x) for x in r["spans"]] for r in got}
    assert spans[1, 1] == [(4, 17)] and spans[7, 1] == [(0, 12), (14, 26)] and spans[4, 4] == [(2, 5)]
    clean = decontaminate.clean_documents(table_of(spark, docs), items).select("doc_id").collect()
    assert sorted(r[0] for r in clean) == [2, 5, 6]
    assert decontaminate.benchmark_matches(table_of(spark, docs), items.where("item_id = 5")).count() == 0


# ---- packing


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(8)
    for _ in range(30):
        n = r.randrange(1, 120)
        sizes = [r.randrange(1, 100) for _ in range(n)]
        sources, clusters = [r.choice([None, *"abcde"]) for _ in range(n)], [r.randrange(60) for _ in range(n)]
        chosen, room = packing.best_fit(sizes, packing.bitmaps(sources, clusters), 100)
        marks = [frozenset([("c", c)] + ([("s", s)] if s else [])) for s, c in zip(sources, clusters)]
        assert chosen == best_fit(sizes, marks, 100)
        assert room == [100 - sum(s for s, b in zip(sizes, chosen) if b == k) for k in range(len(room))]


def check_packed(rows, texts, capacity):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["source"], r["copy"], r["hash"] if "hash" in r else None), []).append(r)
        if r["bin_id"] is None:
            assert r["length"] == 0
        else:
            by_bin.setdefault(r["bin_id"], []).append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: r["position"])
        at = 0
        for k, r in enumerate(own):
            assert (r["position"], r["offset"]) == (k, at)
            at += r["length"] + 1
        assert at + own[0]["room_left"] == capacity
        sources = [r["source"] for r in own if r["source"] is not None]
        assert len(set(sources)) == len(sources)
    assert sorted(r["length"] for r in rows) == sorted(
        min(capacity - 1, len(t) - s) for t in texts for s in range(0, max(len(t), 1), capacity - 1)
    )


def test_packing_query(spark, folder):
    docs = table(spark, folder, "documents").collect()
    got = [r.asDict() for r in QUERIES["op1_packing"](spark, folder).collect()]
    check_packed(got, [d["text"] for d in docs], 16_384)


def test_near_copies_share_no_bin(spark, tmp_path):
    rows = [(i, t, f"s{i}") for i, t, _ in varied(5, 12, 4)]
    rows += [(None, rows[0][1], "n"), (3, rows[7][1], "m"), (3, rows[7][1], "m"), *[(i, t, None) for i, t, _ in ODD if i not in (3, 4, 5)]]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in QUERIES["op1_packing"](spark, str(tmp_path)).where("bin_id is not null").collect()]
    assert len(got) == sum(bool(t) for _, t, _ in rows)
    alike = near_copies([(k, t) for k, (_, t, _) in enumerate(rows)])
    root = {}
    for k, (i, t, s) in enumerate(rows):
        root.setdefault((i, s, len(t or "")), alike[k][0])
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["bin_id"], []).append(root[r["doc_id"], r["source"], r["length"]])
    assert all(len(set(own)) == len(own) for own in by_bin.values()) and max(map(len, by_bin.values())) > 5


@pytest.mark.parametrize("group", [4_096, 7])
def test_packing_of_odd_rows(spark, group):
    docs = table_of(spark, ODD)
    got = [r.asDict() for r in packing.packed(docs, 1_000, group).collect()]
    check_packed(got, [t or "" for _, t, _ in ODD], 1_000)
    whole = packing.packed_texts(docs, 1_000, group).collect()
    assert len(whole) == len(got)
    assert all(len(r["text"]) == r["length"] for r in whole)
    longest = sorted((r for r in whole if r["doc_id"] == 3), key=lambda r: r["start"])
    assert "".join(r["text"] for r in longest) == LONG
    assert packing.packed(table_of(spark, [])).count() == 0
