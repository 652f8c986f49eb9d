"""Importance resampling against a plain loop over every feature."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _words, resampling
from test_llm_operators import DOCS, EDGE_TEXTS, LOWER, docs, rows, sample

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    ws = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)], len(ws)


def brute(table, target, least=20, share=(5, 100), seed=42):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x)[0]) for texts in ([x for _, x in table], target))
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for i, text in table:
        found, words = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: share[0] * len(able) // share[1]])}
    return sorted((str(r[:4]), rank.get(id(r))) for r in out)


def got(df):
    return sorted((str([r["doc_id"], r["n_features"], r["weight"], r["score"]]), r["rank"]) for r in rows(df))


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_joined_crc_equals_zlib():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(n)) for n in [0, 1, 2, 7, 63, 64, 65, 300, 70000]]
    crc = lambda side: np.array([zlib.crc32(side(p)) for p in pairs], dtype=np.uint32)
    joined = resampling.joined_crc(crc(lambda p: p[0]), crc(lambda p: p[1]), np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_word_codes_equal_a_regex():
    texts = EDGE_TEXTS + ["tail", "", " lead", "Mixed CASE mixed-case9"]
    codes, own, distinct = _words.word_codes(pa.array(texts), _words.ALNUM)
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        assert [names[c] for c in codes[own[i] : own[i + 1]]] == WORDS.findall((t or "").translate(LOWER))
    assert len(set(names)) == len(names)


@pytest.mark.parametrize("heavy", [1000, 3])
def test_report_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr("tessera.llm._common.HEAVY", heavy)
    texts = sample(spark) + EDGE_TEXTS + ["the same text again " * 10] * 40
    goal = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, ""]
    df = docs(spark, texts, extra=True)
    assert got(resampling.importance_report(df, target(spark, goal), share=(30, 100))) == brute(list(enumerate(texts)), goal, share=(30, 100))


def test_repeated_rows_null_ids_and_ties(spark):
    text = "one two three four five six seven eight nine ten " * 3
    table = [(None, text)] * 30 + [(7, text)] * 30 + [(i, text + str(i % 3)) for i in range(40)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in table], DOCS)
    assert got(resampling.importance_report(df, target(spark, ["one two"]), share=(60, 100))) == brute(table, ["one two"], share=(60, 100))


def test_empty_sides(spark):
    assert resampling.importance_report(docs(spark, []), target(spark, ["a b"])).count() == 0
    texts = ["a b c " * 10, "d e f " * 10, None]
    assert got(resampling.importance_report(docs(spark, texts), target(spark, []), share=(1, 2))) == brute(list(enumerate(texts)), [], share=(1, 2))


def test_counts_of_many_copies_are_exact():
    batch = pa.RecordBatch.from_pydict({"text": ["a b", "a"], "copies": pa.array([(1 << 52) + 1, 3], pa.int64())})
    out = {b: n for r in resampling._count([batch]) for b, n in zip(r["bucket"].to_pylist(), r["n"].to_pylist())}
    assert out[zlib.crc32(b"a") % 10000] == (1 << 52) + 4


def test_resample_keeps_drawn_rows_whole(spark):
    texts = sample(spark)
    df = docs(spark, texts, extra=True)
    goal = target(spark, texts[:3])
    drawn = {r["doc_id"] for r in rows(resampling.importance_report(df, goal, share=(1, 4)).filter(F.col("rank").isNotNull()))}
    out = resampling.resample(df, goal, share=(1, 4))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in rows(out)) == sorted(drawn) and drawn
