"""Mixing sources to target weights by systematic sampling, with Spark expressions only.

Documents of a source are laid out in a fixed order: by size class, largest first, then by blocks, size and id.
Their expected copies are summed up along it, one random offset a source is added, and a document is emitted once
for each whole number its stretch crosses. A class expects (words still wanted) / (words still to come) copies of
each of its documents, so what whole copies of large documents overshot or missed is made good by the smaller
ones that follow, and the words taken end within about one small document of the target.

No task holds a whole source: rows are ranked inside blocks of bounded size, and only the classes' and blocks'
counts are summed along a source. A run of equal rows, which no block can part, is one weighted row of its block;
its rows are numbered in the stretches in which they were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, fresh, need

SPACES = r"[^\x20\x09-\x0D]+"
#: Size classes a unit of the root of the size, and the rows a block aims at.
CLASSES, BLOCK_ROWS = 2, 20_000
#: In a block of over twice its rows, more equal rows than this are a run.
RUN_ROWS = 1_000
BLOCK = ("source", "cls", "part")
RUN = (*BLOCK, "size", "scatter", "doc_id")
#: Expected copies are whole numbers of this many halvings of one, so prefix sums are exact and a rate of the cap
#: gives each document just the cap. A source may have 2**39 documents.
UNIT = 24


def _scatter(c):
    """A number below 2**32 from a string column; md5, so that any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """source, source_size, target for a table of source, size.

    Sources in code-point order, null last, get the weights in turn. The targets share the sum of all sizes by
    weight; none exceeds cap times its source's size, and what it would have had goes to the others by weight.
    With r = cap * size / weight rising, the sources below the water line r <= level are those capped.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(k, F.lit(len(weights))) + 1).cast("int"))
    w = s.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    rising = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    lined = w.withColumn("level", level)
    # The first source whose cap lies above its level sets the line for itself and all after it.
    open_level = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source").isNull().alias("last"), "source", "level"))).over(everything)
    return lined.select("source", "source_size", F.least(F.col("most"), F.coalesce(open_level["level"] * F.col("weight"), F.col("most"))).alias("target"))


def mix_copies(docs: DataFrame, *keep: str, weights=(5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document, and the columns named in keep.

    size: words of the text; a null or empty text has 0. A null source is a source of its own; a null doc_id
    counts as the smallest. Ties and repeated rows are equal but for their place in the order, so any order of
    them gives the same rows; columns of keep, in their order, break ties. Rows of one id and text in large numbers
    (a run) are numbered in the order in which they were read, whatever keep holds. Other columns are ignored. An empty table gives no rows; where all sizes are 0,
    targets and copies are 0. Reruns agree: order and offset follow from the rows and seed alone.
    """
    tmp = Scratch(docs.sparkSession, "mix")
    own = {c: docs.schema[c].dataType.simpleString() for c in keep}
    # Rows scatter by id and text, so that those without an id or with a shared one scatter too.
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    rows = need(docs, doc_id="long", source="string", text="string", **own).select("doc_id", "source", word_count(F.col("text")).alias("size"), _scatter(key).alias("scatter"), *keep)
    # Size class, largest first; a scattered number that splits a class into blocks.
    cls = F.floor(F.sqrt(F.col("size").cast("double")) * CLASSES).cast("long")
    narrow = tmp.save(rows.select("doc_id", "source", "size", *keep, cls.alias("cls"), "scatter", F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}").alias("stretch")), "sizes")
    per_class = narrow.groupBy("source", "cls").agg(F.count("*").alias("n"))
    wide = per_class.select(F.col("source").alias("s2"), F.col("cls").alias("c2"), F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    placed = tmp.save(
        narrow.join(wide, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cls") == F.col("c2"))).select(
            "doc_id", "source", "size", *keep, "cls", "scatter", "stretch", F.floor(F.col("scatter") * F.col("parts") / F.lit(1 << 32)).cast("long").alias("part")
        ),
        "placed",
    )
    along = Window.partitionBy("source", "cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("source", "cls", "part").agg(F.count("*").alias("n"), F.sum("size").alias("w")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    offset = F.shiftright(_scatter(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))), 32 - UNIT)
    share = targets(narrow, weights, cap).withColumn("offset", offset).withColumnRenamed("source", "s2")
    rates = _rates(blocks, share, cap)
    plan = tmp.save(
        blocks.join(rates, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cls") == F.col("c2"))).select(
            F.col("source").alias("s3"), F.col("cls").alias("c3"), F.col("part").alias("p3"), "n", "before", "source_size", "target", "offset", "rate", "passed"
        ),
        "plan",
    )
    crowded = plan.filter(F.col("n") > 2 * BLOCK_ROWS)
    if crowded.isEmpty():
        rank = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.desc("size"), "scatter", "doc_id", *keep))
        ranked = placed.withColumn("rank", rank).join(plan, _in_block())
    else:
        ranked = _ranked_runs(tmp, placed, plan, crowded, keep)
    at = F.col("before") + F.col("rank")
    crossed = lambda n: F.shiftright(F.col("offset") + F.col("passed") + F.col("rate") * n, UNIT)
    copies = F.when(F.col("size") > 0, crossed(at) - crossed(at - 1)).otherwise(F.lit(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *keep)


def _in_block():
    return F.col("source").eqNullSafe(F.col("s3")) & (F.col("cls") == F.col("c3")) & (F.col("part") == F.col("p3"))


def _ranked_runs(tmp: Scratch, placed: DataFrame, plan: DataFrame, crowded: DataFrame, keep) -> DataFrame:
    """placed with rank and the columns of plan. A run of equal rows takes its ranks as one row of that weight, and
    gives them out by its stretches, of at most BLOCK_ROWS rows: no key that rows meet under has more."""
    same = lambda cols: [F.col(c).eqNullSafe(F.col("r_" + c)) for c in cols]
    counts = placed.join(crowded, _in_block(), "left_semi").groupBy(*RUN, "stretch").agg(F.count("*").alias("m"))
    whole = Window.partitionBy(*RUN)
    ahead = F.coalesce(F.sum("m").over(whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.withColumns({"ahead": ahead, "all": F.sum("m").over(whole)}).filter(F.col("all") > RUN_ROWS)
    runs = tmp.save(runs.select(*[F.col(c).alias("r_" + c) for c in (*RUN, "stretch")], "ahead", "all"), "runs")
    single = placed.join(runs, same((*RUN, "stretch")), "left_anti")
    heads = runs.filter("ahead = 0").select(*[F.col("r_" + c).alias(c) for c in RUN], "all")
    before = Window.partitionBy(*BLOCK).orderBy(F.desc("size"), "scatter", "doc_id", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.coalesce("all", F.lit(1))).over(before), F.lit(0))
    entries = tmp.save(single.unionByName(heads, allowMissingColumns=True).withColumn("rank", start + 1).join(plan, _in_block()), "entries")
    of_plan = ("before", "source_size", "target", "offset", "rate", "passed")
    known = entries.filter("all is not null").select(*RUN, "rank", *of_plan)
    dealt = known.join(runs, same(RUN)).select(*["r_" + c for c in (*RUN, "stretch")], F.col("rank").alias("first"), "ahead", *of_plan)
    within = F.row_number().over(Window.partitionBy(*RUN, "stretch").orderBy(*(keep or [F.lit(0)])))
    hot = placed.join(dealt, same((*RUN, "stretch"))).withColumn("rank", F.col("first") + F.col("ahead") + within - 1)
    cols = (*placed.columns, "rank", *of_plan)
    return entries.filter("all is null").select(*cols).unionByName(hot.select(*cols))


def _rates(blocks: DataFrame, share: DataFrame, cap: float) -> DataFrame:
    """s2, c2, rate, passed of every class: the copies each of its documents expects, and the expected copies of all
    classes before it, both in units. A source has some 2 * sqrt(largest size) classes, which one row folds over."""
    classes = blocks.groupBy("source", "cls").agg(F.sum("n").alias("n"), F.sum("w").cast("double").alias("w"))
    listed = classes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("cls")).alias("k"), "n", "w"))).alias("cs"))
    at = listed.join(share, F.col("source").eqNullSafe(F.col("s2")))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    start = F.struct(F.col("target").alias("want"), F.col("source_size").cast("double").alias("left"), none.alias("passed"), F.expr("cast(array() as array<struct<k:bigint,rate:bigint,passed:bigint>>)").alias("out"))

    def step(acc, c):
        share = F.when(acc["left"] > 0, F.least(F.lit(float(cap)), F.greatest(zero, acc["want"] / acc["left"]))).otherwise(zero)
        rate = F.floor(share * float(1 << UNIT)).cast("long")
        passed = acc["passed"] + rate * c["n"]
        taken = (F.shiftright(F.col("offset") + passed, UNIT) - F.shiftright(F.col("offset") + acc["passed"], UNIT)).cast("double")
        return F.struct(
            (acc["want"] - taken * (c["w"] / c["n"])).alias("want"),
            (acc["left"] - c["w"]).alias("left"),
            passed.alias("passed"),
            F.concat(acc["out"], F.array(F.struct(c["k"].alias("k"), rate.alias("rate"), acc["passed"].alias("passed")))).alias("out"),
        )

    folded = at.select("s2", "source_size", "target", "offset", F.explode(F.aggregate("cs", start, step, lambda acc: acc["out"])).alias("r"))
    return folded.select("s2", "source_size", "target", "offset", (-F.col("r.k")).alias("c2"), F.col("r.rate").alias("rate"), F.col("r.passed").alias("passed"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The columns of op1: every document with the words the mix takes from it, repeats counted."""
    return mix_copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row's columns, once for every copy taken of it, with its number as copy_no.

    Copies belong to rows: rows without a doc_id, and each of several with one, give the copies planned for
    them. The rows are saved with a number of their own, by which the copies find them. Rows without words take
    no part. Where docs has a column copy_no already, the number's name gets an underscore.
    """
    tmp = Scratch(docs.sparkSession, "mixed")
    tie, row, key, copies, number = (fresh(docs, n) for n in ("__tie", "__row", "__id", "__copies", "copy_no"))
    # Ties among rows of one id and size go by text first, so that reruns take copies of the same texts.
    saved = tmp.save(docs.withColumn(tie, F.xxhash64(F.col("text").cast("string"))).withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix_copies(saved, tie, row, **options).filter(F.col("copies") > 0).select(F.col(row).alias(key), F.col("copies").alias(copies))
    out = saved.join(taken, F.col(row) == F.col(key))
    return out.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(key, copies, row, tie)
