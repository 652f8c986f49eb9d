"""Source divergence audit: how far the sources of a language are from each other, and in which terms.

A language keeps the terms of MIN_DOCS of its documents. Each of its sources, and the language itself, gives each
kept term a smoothed share in units of 1 / SCALE; the divergence of two shares p and q is (p - q)**2 / (p + q),
and that of two sources is the sum over all kept terms. All of it is exact whole-number arithmetic.

Sums over pairs of sources split by how many sources hold a term. A heavy term, held by more than the root of the
number of the language's sources, is a column of a dense tile: SLICE terms or so, by two blocks of sources, added
up with numpy. A light term is absent from nearly all sources. A pair of sources is first taken to hold no term at
all; tiles put their columns in the place of this, and postings of light terms correct it: once a source against
all that lack the term, where postings of one count are one row, and once a pair of sources that both hold it. A
light term has at most as many such pairs as the language has sources. Both partial sums add up to the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, need, pieces
from ._words import LETTERS, word_codes

# Fixed values of the task's contract.
MIN_DOCS, SCALE, TOP = 10, 10**9, 10
#: Sources in a block and terms in a slice of a dense tile, on average.
BLOCK, SLICE = 48, 256

TERMS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, a string, b string, value long"


def _count_terms(batches):
    """TERMS of a piece of documents, and a row without a term for each of its groups."""
    names = [c.split()[0] for c in TERMS.split(", ")]
    for batch in pieces(batches):
        lang, source = (batch.column(c).cast(pa.large_string()).dictionary_encode() for c in ("lang", "source"))
        both = np.asarray(lang.indices, dtype=np.int64) * max(1, len(source.dictionary)) + np.asarray(source.indices, dtype=np.int64)
        groups, group = np.unique(both, return_inverse=True)
        codes, own, terms = word_codes(batch.column("text"), LETTERS)
        doc, many = np.repeat(np.arange(len(own) - 1), np.diff(own)), max(1, len(terms))
        said, times = np.unique(doc * many + codes, return_counts=True)
        held, at = np.unique(group[said // many] * many + said % many, return_inverse=True)
        n, docs = np.bincount(at, times, len(held)).astype(np.int64), np.bincount(at, minlength=len(held))
        of = np.concatenate([groups[held // many], groups])
        cols = [
            lang.dictionary.take(pa.array(of // max(1, len(source.dictionary)))),
            source.dictionary.take(pa.array(of % max(1, len(source.dictionary)))),
            pa.concat_arrays([terms.take(pa.array(held % many)), pa.nulls(len(groups), pa.large_string())]),
            pa.array(np.concatenate([n, np.zeros(len(groups), np.int64)])),
            pa.array(np.concatenate([docs, np.zeros(len(groups), np.int64)])),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in cols], names)


def share(n, size, kept, div=lambda a, b: a // b):
    """1 + floor(SCALE * (n + 2) / (size + 2 * kept)), in two steps that stay within 64 bits up to 9e13 words.

    size: words of the group; kept: terms of the language, at least one. Works on numbers, arrays and, with a
    div of theirs, on columns.
    """
    whole, step = size + 2 * kept, 10**5
    first = (n + 2) * step
    return 1 + div(first, whole) * (SCALE // step) + div((first % whole) * (SCALE // step), whole)


def diverge(p, q, div=lambda a, b: a // b):
    """floor((p - q)**2 / (p + q))"""
    return div((p - q) * (p - q), p + q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, size: Column, kept: Column) -> Column:
    return share(n, size, kept, _div)


def _diverge(p: Column, q: Column) -> Column:
    return diverge(p, q, _div)


def _tile(key, rows):
    """PARTIAL of one tile: two blocks of sources of one language by one slice of its heavy terms and postings."""
    lang, one, two, slice_ = (k.as_py() for k in key)
    terms = rows["kept"][0].as_py()
    kept = max(1, terms)
    source = rows["source"].combine_chunks().dictionary_encode()
    at, names = np.asarray(source.indices, dtype=np.int64), source.dictionary.to_pylist()
    size, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    size[at], block[at] = np.asarray(rows["size"]), np.asarray(rows["block"])
    n, times = np.asarray(rows["n"]), np.asarray(rows["times"])
    term = rows["term"].combine_chunks().dictionary_encode()
    dense = np.flatnonzero(np.asarray(term.is_valid()))
    count = np.zeros((len(names), len(term.dictionary)), np.int64)
    count[at[dense], np.asarray(term.indices.take(pa.array(dense)), dtype=np.int64)] = n[dense]
    p, absent = share(count, size[:, None], kept), share(0, size, kept)
    posting = np.flatnonzero(times > 0)
    corrected = np.zeros((len(names), len(names)), np.int64)
    for g in np.unique(at[posting]):
        own = posting[at[posting] == g]
        shift = diverge(share(n[own], size[g], kept)[:, None], absent[None, :]) - diverge(absent[g], absent)[None, :]
        corrected[g] = (shift * times[own][:, None]).sum(axis=0)
    a, b, value = [], [], []
    for i in np.flatnonzero(block == one):
        with_ = np.flatnonzero(block == two)
        with_ = with_[with_ > i] if one == two else with_
        if not len(with_):
            continue
        # All terms as if neither had them, once; the columns of this tile in their place.
        lacked = (terms if slice_ == 0 else 0) - count.shape[1]
        total = diverge(p[i][None, :], p[with_]).sum(axis=1) + lacked * diverge(absent[i], absent[with_]) + corrected[i, with_] + corrected[with_, i]
        for j, v in zip(with_.tolist(), total.tolist(), strict=True):
            lo, hi = sorted((names[i], names[j]))
            a.append(lo), b.append(hi), value.append(v)
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], [c.split()[0] for c in PARTIAL.split(", ")])


def _tables(tmp: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, postings). groups: lang, source, size (words of kept terms), kept, whole (words of the language),
    sources; postings: lang, source, term, n of all kept terms, with held (sources that hold it) and total (n of
    the language).
    """
    blank = need(docs, text="string", lang="string", source="string").fillna("")
    terms = blank.mapInArrow(_count_terms, TERMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = tmp.save(terms, "counts")
    of_term = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
    kept = of_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("held")).filter(F.col("docs") >= MIN_DOCS)
    postings = tmp.save(counts.filter(F.col("term").isNotNull()).drop("docs").join(kept.drop("docs"), ["lang", "term"]), "postings")
    known = counts.filter(F.col("term").isNull()).select("lang", "source")
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms_of = postings.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    langs = known.groupBy("lang").agg(F.count("*").alias("sources")).join(terms_of, "lang", "left")
    groups = tmp.save(known.join(sizes, ["lang", "source"], "left").join(langs, "lang").fillna(0, ["size", "kept", "whole"]), "groups")
    tmp.drop(counts)
    return groups, postings


def _pairs(tmp: Scratch, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """PARTIAL, summed: the divergence of every two sources of a language, a before b."""
    wide = postings.join(groups.select("lang", "source", "size", "kept", "sources"), ["lang", "source"])
    is_light = F.col("held") * F.col("held") <= F.col("sources")
    light, heavy = wide.filter(is_light), wide.filter(~is_light)
    # Postings of one source and count make the same correction.
    same = tmp.save(light.groupBy("lang", "source", "size", "n").agg(F.count("*").alias("times")), "same")
    terms = heavy.groupBy("lang").agg(F.count_distinct("term").alias("heavy"))
    rows = same.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = groups.select("lang", "kept", "sources").distinct().join(terms, "lang", "left").join(rows, "lang", "left").fillna(0)
    slices = F.ceil((F.col("heavy") + F.col("rows") / F.col("sources")) / SLICE)
    langs = tmp.save(langs.select("lang", "kept", F.ceil(F.col("sources") / BLOCK).alias("blocks"), F.greatest(slices, F.lit(1)).alias("slices")), "langs")

    none = F.lit(None).cast("string")
    marks = groups.select("lang", "source", "size", none.alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("times"))
    marks = marks.join(langs, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = heavy.select("lang", "source", "size", "term", "n", F.lit(0).cast("long").alias("times")).unionByName(same.withColumn("term", none))
    dealt = dealt.join(langs, "lang").withColumn("slice", F.pmod(F.xxhash64(F.coalesce("term", F.col("n").cast("string"))), F.col("slices")))
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    tiles = marks.unionByName(dealt).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    dense = tiles.select("lang", "one", "two", "slice", "source", "size", "block", "term", "n", "times", "kept").groupBy("lang", "one", "two", "slice").applyInArrow(_tile, PARTIAL)

    p, absent = _share(F.col("n"), F.col("size"), F.col("kept")), _share(F.lit(0).cast("long"), F.col("size"), F.col("kept"))
    shared = light.filter("held > 1").select("lang", "term", "source", p.alias("p"), absent.alias("z"))
    one = shared.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    two = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    both = _diverge(pa_, pb) - _diverge(pa_, zb) - _diverge(za, pb) + _diverge(za, zb)
    sparse = one.join(two, ["lang", "term"]).filter("a < b").select("lang", "a", "b", both.alias("value"))
    return dense.unionByName(sparse).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence_report(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: for each source of a language every other one, and their divergence. Part term: the TOP terms by
    their share of the divergence of a source from its language, of those that it uses more. rank counts from 1,
    the largest value first, then the smaller item. Null lang, source and text count as empty. A language without
    kept terms has divergences of 0 and no terms; a lone source has no pairs. Repeated rows are documents of
    their own, other columns are ignored, an empty table gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "divergence")
    groups, postings = _tables(tmp, docs)
    sums = tmp.save(_pairs(tmp, groups, postings), "pairs")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = sums.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    wide = postings.join(groups.select("lang", "source", "size", "kept", "whole"), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("size"), F.col("kept")), _share(F.col("total"), F.col("whole"), F.col("kept"))
    used = wide.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _diverge(F.col("p"), F.col("q")).alias("value"))
    top = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(top)
