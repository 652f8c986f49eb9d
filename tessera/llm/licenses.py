"""License scans with Spark expressions only: ordered signature rules over normalised words.

A text is lower-cased (A-Z) and its words joined by single blanks, so one space stands between words and every
rule is a pattern of words. A prefilter comes first: every rule has an anchor, a word that all its matches hold, and
a keyword, a longer piece of text that they hold. The text's words are met once with all anchors, and only rules
whose anchor and keyword the text holds run. Each detection is a word interval with its rule's priority; one that
lies inside another of higher priority, or of equal priority and greater length, is dropped. Overlaps without
containment stay. The rules are those of license_rules, written by hand, and the base phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, need, running, running_sums
from .license_rules import anchor, read_rules

# Fixed values of the task's contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Priority of the base phrases, above every other rule's.
FIRST = 100


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of every rule, the highest priority first."""
    return [(FIRST, label, phrase, phrase) for phrase, label in BASE.items()] + read_rules()


def words_text(text: Column) -> Column:
    """The words of a text, each with one blank before it, and one at the end; a blank alone without words."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _places(norm: Column, pattern: Column) -> Column:
    """array<struct<start, end>>: word intervals (end exclusive) of a pattern's matches, left to right."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, whole, F.lit(0))
    gaps = F.transform(F.split(norm, whole, -1), _blanks)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(found, _blanks).alias("inner"))

    def placed(p):
        ends = running_sums(F.transform(p, lambda s: s["gap"] + F.coalesce(s["inner"], F.lit(0))))
        rows = F.filter(F.arrays_zip(ends.alias("end"), p.alias("p")), lambda r: r["p"]["inner"].isNotNull())
        return F.transform(rows, lambda r: F.struct((r["end"] - r["p"]["inner"] - 1).alias("start"), r["end"].alias("end")))

    return bound(steps, placed)


def _resolve(hits: Column, levels: list[int]) -> Column:
    """Detections (start, less = -end, rank = -priority, label) that no other one holds and outranks.

    Sorted by start, then the later end, then the higher priority, whatever may hold a detection stands before
    it. For each priority, running maxima along the order tell how far the detections above it reach, and how far
    its own: of those the later end, and of one end the earlier start, is the longer.
    """
    long = lambda h: F.call_function("shiftleft", -h["less"], F.lit(32)) - h["start"]
    top = F.array(*[F.lit(-p) for p in levels])

    def kept(h):
        most = lambda f: F.transform(top, lambda r: running(F.transform(h, lambda x: f(x, r)), F.greatest, -1))
        above = most(lambda x, r: F.when(x["rank"] < r, -x["less"]).otherwise(F.lit(-1)))
        same = most(lambda x, r: F.when(x["rank"] == r, long(x)).otherwise(F.lit(-1)))
        at = lambda table, x, i: F.get(F.get(table, (F.array_position(top, x["rank"]) - 1).cast("int")), i)
        return bound(F.struct(above.alias("above"), same.alias("same")), lambda m: F.filter(h, lambda x, i: (at(m["above"], x, i) < -x["less"]) & (at(m["same"], x, i) <= long(x))))

    return F.when(F.size(hits) < 2, hits).otherwise(bound(F.array_sort(F.array_distinct(hits)), kept))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and found of every document.

    base: array<struct<start, end, label>>, every place of a base phrase. found: array<struct<start, end,
    priority, label>>, the detections that stay. Null and empty texts have no words. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows. Each row is judged alone.
    """
    rows = need(docs, doc_id="long", text="string").select("doc_id", words_text(F.col("text")).alias("norm"))
    book = rules()
    by: dict[str, list[str]] = {}
    for p, label, keyword, pattern in book:
        by.setdefault(anchor(pattern), []).append(f"named_struct('rank',{-p},'label','{label}','keyword','{keyword}','pattern','{pattern}')")
    # One literal array, parsed once; the rules hold no quotes or backslashes.
    shelf = F.expr("array(" + ",".join(f"named_struct('anchor','{w}','rules',array({','.join(r)}))" for w, r in by.items()) + ")")
    norm = F.col("norm")
    none = F.expr("cast(array() as array<struct<start:bigint,less:bigint,rank:int,label:string>>)")
    of_rule = lambda r: F.transform(_places(norm, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("less"), r["rank"].alias("rank"), r["label"].alias("label")))
    of_anchor = lambda k: F.flatten(F.transform(F.filter(k["rules"], lambda r: F.contains(norm, r["keyword"])), of_rule))
    held = F.array_intersect(F.split(norm, " "), F.expr("array(" + ",".join(f"'{w}'" for w in by) + ")"))
    hits = bound(held, lambda words: F.when(F.size(words) == 0, none).otherwise(F.flatten(F.transform(F.filter(shelf, lambda k: F.array_contains(words, k["anchor"])), of_anchor))))
    step = rows.select("doc_id", (_blanks(norm) - 1).alias("n_words"), hits.alias("hits"))
    end = lambda h: (-h["less"]).alias("end")
    base = F.transform(F.filter("hits", lambda h: h["rank"] == -FIRST), lambda h: F.struct(h["start"].alias("start"), end(h), h["label"].alias("label")))
    found = F.transform(_resolve(F.col("hits"), sorted({r[0] for r in book}, reverse=True)), lambda h: F.struct(h["start"].alias("start"), end(h), (-h["rank"]).alias("priority"), h["label"].alias("label")))
    return step.select("doc_id", "n_words", base.alias("base"), found.alias("found"))


def license_report(docs: DataFrame) -> DataFrame:
    """The digest columns of op7, from scan_licenses. score: s / (s + 50), s the sum of the detections' priorities."""
    d = scan_licenses(docs)
    starts = F.transform("base", lambda b: b["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    of_base = F.transform("base", lambda b: b["label"])
    strength = F.aggregate("found", F.lit(0), lambda acc, f: acc + f["priority"]).cast("double")
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.concat(of_base, F.transform("found", lambda f: f["label"]))).alias("labels"),
        (strength / (strength + F.lit(50.0))).alias("score"),
    )
