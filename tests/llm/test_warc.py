"""WARC archives: round trips, framing, and what a broken archive says."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, warc
from test_llm_operators import rows

PAGES = "page_id long, url string, html string"


def brute(table):
    most, out = {}, []
    for i, _, html in table:
        key = (html or "").encode()
        if i is not None:
            most[key] = max(most.get(key, i), i)
    for i, _, html in table:
        key = (html or "").encode()
        keeper = most.get(key)
        again = keeper is not None and i != keeper
        out.append((i, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows(df))


def written(spark, tmp_path, table, most=warc.ARCHIVE):
    tmp = _common.Scratch(spark, "warc")
    return warc.write_pages(tmp, spark.createDataFrame(table, PAGES), f"file://{tmp_path}/files", most)


@pytest.mark.parametrize("heavy", [1000, 4])
def test_report_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr("tessera.llm._common.HEAVY", heavy)
    rng = random.Random(3)
    htmls = [None, "", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 300000, "same"] + [f"<b>{rng.random()}</b>" * rng.randint(1, 200) for _ in range(20)]
    table = [(i, rng.choice([None, "http://a.b/c d\r\nX: y", "http://é.com/"]), rng.choice(htmls)) for i in range(120)]
    table += [(500 + i, "http://hot", "same") for i in range(60)] + [(None, None, "same"), (None, None, "alone"), (7, "u", "twice"), (7, "u", "twice")]
    df = spark.createDataFrame(table, PAGES).withColumn("record_id", F.lit(1)).withColumn("payload", F.lit(1))
    assert got(warc.warc_report(df)) == brute(table)
    assert warc.warc_report(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_hold_one_member_a_record_and_any_reader_reads_them(spark, tmp_path):
    table = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(40)]
    files = written(spark, tmp_path, table, most=2000)
    listed = rows(files)
    assert sum(r["records"] for r in listed) == 40 and len(listed) > 2
    for r in listed:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        assert len(data) == r["bytes"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == r["records"]
    records = warc.read_archives(files)
    for path in {r["path"] for r in listed}:
        data = open(path.removeprefix("file://"), "rb").read()
        for r in rows(records.filter(F.col("path") == path)):
            assert gzip.GzipFile(fileobj=io.BytesIO(data[r["offset"] :])).read(12) == b"WARC/1.1\r\nWA"
    sound = rows(records)
    assert all(r["fault"] is None for r in sound) and len({r["record_id"] for r in sound}) == 40
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in sound if r["record_type"] == "response"} == {i: f"<p>{i % 7}</p>" * 50 for i in range(33, 40)}
    assert {r["refers_to_id"] for r in sound} - {None} == {r["record_id"] for r in sound if r["record_type"] == "response"}


def read(data, step=warc.STEP):
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, step))

    return [warc._row("p", o, f, b, x, True) for o, f, b, x in warc._records(Slow(data))]


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_steps_of_any_size_read_the_same(step):
    payloads = [b"", b"a" * 5_000_000 if step > 7 else b"a" * 5000, "é\r\n\r\n".encode() * 100]
    data = b"".join(warc._member(warc.record(i, "http://x", p, None, False)) for i, p in enumerate(payloads))
    found = read(data, step)
    assert [r[7] for r in found] == payloads and all(r[-1] is None for r in found)


def test_faults():
    good = warc.record(1, "http://x", b"hello", None, False)
    member = warc._member
    fault = lambda data: [r[-1] for r in read(data)]
    assert fault(b"") == []
    assert fault(member(good) + member(good)) == [None, None]
    assert fault(member(good.replace(b"hello", b"jello")) + member(good)) == ["block digest", None]
    assert fault(member(good[:-4])) == ["length"] and fault(member(good + b"x")) == ["length"]
    assert fault(member(good[:-8])) == ["truncated"] and fault(member(good)[:-3]) == ["truncated"]
    assert fault(member(b"HTTP/1.1 200 OK\r\n\r\n") + member(good)) == ["header", None]
    assert fault(b"no gzip at all") == ["gzip"] and fault(member(good) + b"junk") == [None, "gzip"]
    assert fault(member(b"WARC/1.1\r\n" + b"x" * 3_000_000)) == ["header"]
    wrong = good.replace(b"WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"hello").encode(), b"WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"other").encode())
    assert fault(member(wrong)) == ["payload digest"]


def test_a_faulty_record_fails_the_job(spark, tmp_path):
    files = written(spark, tmp_path, [(1, "u", "a"), (2, "u", "a"), (3, "u", "b")])
    for r in rows(files):
        at = r["path"].removeprefix("file://")
        data = open(at, "rb").read()
        with open(at, "wb") as out:
            out.write(data[:-5])
    tmp = _common.Scratch(spark, "warc")
    with pytest.raises(Exception, match="faulty record"):
        warc.resolve(tmp, tmp.save(warc.read_archives(files), "r")).collect()
