import gzip
import hashlib
import io

import pytest
from checks import database, rows_of
from plain import LONG, ODD, order_minhash, table_of

from pulseline.llm import order_minhash as omh
from pulseline.llm import warc
from pulseline.llm.common import table
from pulseline.llm.queries import QUERIES
from pulseline.session import work_dir


def prints(spark, texts):
    df = omh.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "p")
    return [r["p"] for r in df.orderBy("i").collect()]


def test_fingerprints_are_those_of_the_definition(spark):
    texts = ["", "one", "one two", "a b a b a b a b c", "to be or not to be " * 30, LONG[:4_000], "x" * 500, "é ñ 😀 é ñ"]
    for text, got in zip(texts, prints(spark, texts)):
        assert list(got) == order_minhash(text, omh.SLOTS, omh.K), text[:30]


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    mixed = [w for pair in zip(words[::2], words[1::2]) for w in pair[::-1]]
    a, b, c = prints(spark, [" ".join(x) for x in (words, turned, mixed)])
    same = lambda x, y: sum(i == j for i, j in zip(x, y)) / omh.SLOTS
    assert same(a, c) < same(a, b) < 0.75


def test_units_do_not_hang_on_the_rest_of_a_text(spark):
    """A run without spaces has the same units whether spaced prose follows or not."""
    run = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(600))
    prose = " ".join(f"w{i}" for i in range(300))
    a, b = prints(spark, [run, run[:300] + " " + prose])
    same = sum(i == j for i, j in zip(a, b)) / omh.SLOTS
    assert 0.05 < same < 0.6


def test_places_beyond_the_last_one(spark, monkeypatch):
    """The order there is not told, but every entry comes from elements of the text."""
    monkeypatch.setattr(omh, "PLACE", (1 << 5) - 1)
    text = " ".join(f"w{i}" for i in range(200))
    (a, b) = prints(spark, [text, text])
    assert len(a) == omh.SLOTS and a == b and -1 not in a


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        n, other = len(t), texts[(i + 1) % len(texts)]
        out.append(t[: n - n // 2] + other[: n // 2])
    return out


def test_fingerprint_query(spark, folder):
    got = QUERIES["op4_order_minhash"](spark, folder).toPandas().sort_values("doc_id")
    docs = table(spark, folder, "documents").toPandas().sort_values("doc_id")
    texts = docs["text"].tolist()
    assert got["n_chars"].tolist() == [len(t) for t in texts]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited(texts)]
    assert got.groupby(docs["text"].to_numpy())["fingerprint"].nunique().max() == 1
    assert (got["near_edited"] > got["near_next"]).mean() > 0.9
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_fingerprints_of_odd_rows(spark):
    got = omh.edited_likeness(table_of(spark, ODD)).toPandas()
    assert len(got) == len(ODD)
    assert sorted(got["n_chars"]) == sorted(len(t or "") for _, t, _ in ODD)
    assert omh.edited_likeness(table_of(spark, [])).count() == 0
    alone = omh.edited_likeness(table_of(spark, [(1, "a b c d", "s")])).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def test_archives_against_sql(spark, folder):
    got = QUERIES["op6_warc"](spark, folder).toPandas()
    assert rows_of(got) == rows_of(database(folder).execute(QUERIES["op6_warc"].sql).df())


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, ""), (4, "u", None), (5, "u", "é\r\n\r\nWARC/1.0"),
         (5, "u", "é\r\n\r\nWARC/1.0"), (None, "u", "same"), (None, "v", "alone"), (6, "x\r\ny", "z" * 300_000)]


def test_pages_come_back(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    path = work_dir(spark, "warc")
    warc.write_pages(pages, path)
    back = warc.read_warc(spark, path)
    rows = {(r["record_id"], r["record_type"]): r for r in back.collect()}
    assert back.count() == len(PAGES)
    assert bytes(rows["<urn:page:6>", "response"]["payload"]) == b"z" * 300_000
    assert bytes(rows["<urn:page:5>", "response"]["payload"]).decode() == "é\r\n\r\nWARC/1.0"
    revisit = rows["<urn:page:1>", "revisit"]
    assert revisit["refers_to"] == "<urn:page:2>" and revisit["payload_bytes"] == 4 and bytes(revisit["payload"]) == b""
    assert ("<urn:page:none>", "revisit") in rows and ("<urn:page:none>", "response") in rows
    only = warc.read_warc(spark, path, ["record_id", "payload_bytes"]).where("payload_bytes = 300000")
    assert [r["record_id"] for r in only.collect()] == ["<urn:page:6>"]
    kept = warc.page_records(pages, least_bytes=5).where("record_type = 'revisit'").count()
    assert kept == 0
    assert warc.page_records(pages.limit(0)).count() == 0


def test_predicates_reach_the_reader(spark, folder):
    path = work_dir(spark, "warc")
    warc.write_pages(spark.createDataFrame(PAGES[:4], "page_id long, url string, html string"), path)
    found = warc.read_warc(spark, path).where("record_type = 'revisit' and target_uri is not null")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert [r["record_id"] for r in found.collect()] == ["<urn:page:1>"]


class Counting(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("form", ["plain", "member", "gzip"])
def test_unwanted_payloads_are_skipped(form):
    import random

    body = random.Random(1).randbytes(3_000_000)
    raw = [warc.record("response", f"<r{i}>", "u", "2024-01-01T00:00:00Z", body + bytes([i]), None) for i in range(3)]
    pack = {"plain": lambda x: x, "member": warc.member, "gzip": gzip.compress}[form]
    file = Counting(b"".join(map(pack, raw)))
    got = list(warc.records(file, lambda h: h["warc-record-id"] == "<r9>", ["record_id", "payload"]))
    assert got == [] and (file.total < 2_000_000 or form == "gzip")
    file.seek(0)
    got = list(warc.records(file, lambda h: h["warc-record-id"] == "<r2>", ["record_id", "payload", "payload_bytes"]))
    assert got == [("<r2>", body + b"\x02", len(body) + 1)]
    # Members are ordinary gzip.
    if form == "member":
        assert gzip.decompress(file.getvalue()) == b"".join(raw)


def test_cut_archive_is_an_error():
    raw = warc.member(warc.record("response", "<r>", "u", "d", b"payload" * 100, None))
    with pytest.raises(Exception):
        list(warc.records(io.BytesIO(raw[:60]), lambda h: True, ["payload"]))
