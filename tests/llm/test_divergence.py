"""Source divergence against a plain loop over every pair and term, in whole numbers."""

import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import divergence
from test_llm_operators import DOCS, EDGE_TEXTS, LOWER, rows, sample

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(table):
    """table: (text, lang, source)."""
    table = [(x or "", a or "", s or "") for x, a, s in table]
    out = []
    for lang in {a for _, a, _ in table}:
        said = [(s, collections.Counter(WORDS.findall(x.translate(LOWER)))) for x, a, s in table if a == lang]
        held = collections.Counter(t for _, c in said for t in c)
        kept = [t for t, n in held.items() if n >= 10]
        count = {s: collections.Counter() for s, _ in said}
        for s, c in said:
            count[s].update({t: n for t, n in c.items() if held[t] >= 10})
        whole = sum(count.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in count.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered)]
    return sorted(out)


def got(spark, table):
    df = spark.createDataFrame([(i, x, a, s, 0) for i, (x, a, s) in enumerate(table)], DOCS)
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows(divergence.divergence_report(df)))


def test_share_stays_exact_for_large_counts():
    rng = random.Random(2)
    for _ in range(2000):
        size, kept = rng.randint(0, 9 * 10**13), rng.randint(1, 10**6)
        n = rng.randint(0, size)
        assert divergence.share(np.int64(n), np.int64(size), kept) == 1 + 10**9 * (n + 2) // (size + 2 * kept)


@pytest.mark.parametrize("block, slice_", [(48, 256), (3, 5), (1, 1)])
def test_report_equals_brute_force(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLICE", slice_)
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(120)]
    table = []
    for i in range(300):
        s = rng.randrange(9)
        own = [w for k, w in enumerate(words) if k % 9 == s or k < 20]  # some terms in all sources, most in one
        table.append((" ".join(rng.choice(own if rng.random() < 0.97 else words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), f"s{s}" if s else None))
    table += [(None, "fr", "a"), ("", "fr", "b"), ("lone words " * 40, "it", "only"), *[("Tie tie", "es", x) for x in "abcdefghij"], ("many " * 500, "en", "ü"), ("x", "en", "nothing")]
    assert got(spark, table) == brute(table)


def test_given_texts_ties_and_repeats(spark):
    table = [(x, "en", f"s{i % 4}") for i, x in enumerate(sample(spark) + EDGE_TEXTS)] * 2
    assert got(spark, table) == brute(table)


def test_empty_table_and_clashing_columns(spark):
    assert divergence.divergence_report(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([("a b", "en", s, 1, "x", 2) for s in ("p", "q")], "text string, lang string, source string, n int, term string, size int")
    assert sorted((r["source"], r["item"], r["value"]) for r in rows(divergence.divergence_report(df))) == [("p", "q", 0), ("q", "p", 0)]
