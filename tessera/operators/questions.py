"""Query templates over the canonical relation: lookups, paths, conjunctions, typed comparisons, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import typed

OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
#: Fixed value: proofs of an answer past which it has no trace rather than part of one.
MOST_PROOFS = 256


def lookup_object(relation: DataFrame, subject: str, rels: list[str]) -> DataFrame:
    return relation.filter((F.col("subject") == subject) & F.col("rel").isin(*rels)).select(F.col("object").alias("answer")).distinct()


def lookup_subject(relation: DataFrame, rels: list[str], obj: str) -> DataFrame:
    return relation.filter((F.col("object") == obj) & F.col("rel").isin(*rels)).select(F.col("subject").alias("answer")).distinct()


def lookup_relation(relation: DataFrame, subject: str, obj: str) -> DataFrame:
    return relation.filter((F.col("subject") == subject) & (F.col("object") == obj)).select(F.col("rel").alias("answer")).distinct()


def discover(relation: DataFrame, entity: str) -> DataFrame:
    """Relation labels of an entity, and the side it stands on."""
    side = lambda c, name: relation.filter(F.col(c) == entity).select("rel", F.lit(name).alias("side"))
    return side("subject", "subject").unionByName(side("object", "object")).distinct()


def hops(relation: DataFrame, start: str, rels: list[str]) -> DataFrame:
    """Ends of the path that follows rels from start. Each step keeps distinct ends only, so paths never multiply."""
    at = relation.filter((F.col("subject") == start) & (F.col("rel") == rels[0])).select(F.col("object").alias("answer")).distinct()
    for r in rels[1:]:
        step = relation.filter(F.col("rel") == r).select(F.col("subject").alias("answer"), F.col("object").alias("next"))
        at = at.join(step, "answer").select(F.col("next").alias("answer")).distinct()
    return at


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def compare(relation: DataFrame, rel: str, kind: str, operator: str, value: str, units: dict[str, int] | None = None) -> DataFrame:
    """Subjects whose value of rel compares so with value, by the exact parser; other types never compare."""
    want = typed.exact_key(kind, F.lit(value), units)
    have: Column = typed.exact_key(kind, F.col("object"), units)
    return relation.filter((F.col("rel") == rel) & F.coalesce(getattr(have, OPERATORS[operator])(want), F.lit(False))).select("subject", "object").distinct()


def incomparable(relation: DataFrame, rel: str, kind: str, units: dict[str, int] | None = None) -> DataFrame:
    """Objects of rel that the exact parser refuses: with any, a comparison over rel gives no verified answer."""
    return relation.filter(F.col("rel") == rel).select("object").distinct().filter(typed.exact_key(kind, F.col("object"), units).isNull())


def provenance(facts: DataFrame, rels: list[str]) -> DataFrame:
    """(subject, answer, fact_ids, proofs) of the path along relations: every fact id of every proof, and how many
    proofs there are.

    Proofs are counted, not listed: a fact is part of a proof if some subject reaches it and some answer is reached
    from it, so what is joined are distinct ends and not the paths between them.
    """
    edges = [facts.filter(F.col("canonical") == r).select(F.col("subject").alias("a"), F.col("object").alias("b"), "id") for r in rels]
    counts = [e.groupBy("a", "b").agg(F.count("*").alias("n")) for e in edges]
    # Ways from each subject to the ends of the first k relations.
    ways = [counts[0].select(F.col("a").alias("subject"), F.col("b").alias("node"), "n")]
    for c in counts[1:]:
        at = ways[-1].withColumnRenamed("n", "so_far").join(c, F.col("node") == F.col("a"))
        ways.append(at.groupBy("subject", F.col("b").alias("node")).agg(F.sum(F.col("so_far") * F.col("n")).alias("n")))
    # Answers of each node after the first k relations.
    leads = [counts[-1].select(F.col("b").alias("node"), F.col("b").alias("answer")).distinct()]
    for c in reversed(counts[1:]):
        at = c.join(leads[0], F.col("b") == F.col("node")).select(F.col("a").alias("node"), "answer").distinct()
        leads.insert(0, at)
    used = None
    for k, e in enumerate(edges):
        before = e.withColumn("subject", F.col("a")) if k == 0 else e.join(ways[k - 1].select("subject", "node"), F.col("a") == F.col("node")).drop("node")
        ids = before.join(leads[k], F.col("b") == F.col("node")).select("subject", "answer", "id")
        used = ids if used is None else used.unionByName(ids)
    listed = used.distinct().groupBy("subject", "answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("fact_ids"))
    return listed.join(ways[-1].select("subject", F.col("node").alias("answer"), F.col("n").alias("proofs")), ["subject", "answer"])


def traced(prov: DataFrame) -> DataFrame:
    """Provenance with fact_ids nulled where a bound is passed: no trace instead of part of one."""
    return prov.withColumn("fact_ids", F.when(F.col("proofs") <= MOST_PROOFS, F.col("fact_ids")))


def exact_facts(facts: DataFrame, entity: str, most: int = 50) -> DataFrame:
    """Facts that name an entity, with the side it stands on: the oldest, one more than the bound, so that
    truncation shows."""
    s, o = F.col("subject") == entity, F.col("object") == entity
    side = F.when(s & o, "both").when(s, "subject").otherwise("object")
    return facts.filter(s | o).select("id", "subject", "relation", "object", side.alias("side")).orderBy("id").limit(most + 1)


# How much of a knowledge base a snapshot shows.
SNAPSHOT = {"relation": 100, "subject": 100, "object": 100, "fact": 50}


def snapshot(relation: DataFrame, facts: DataFrame, entity: str) -> DataFrame:
    """(part, position, label, beyond): the first relation labels, subjects and objects in order, and the oldest
    facts of an entity, each list with one more row than its bound: beyond marks that row, so truncation shows."""
    lists = {"relation": relation.select(F.col("rel").alias("label")), "subject": relation.select(F.col("subject").alias("label")), "object": relation.select(F.col("object").alias("label"))}
    lists["fact"] = exact_facts(facts, entity, SNAPSHOT["fact"]).select(F.format_string("%019d", "id").alias("label"))
    out = None
    for part, df in lists.items():
        # The window runs over the bounded list alone.
        top = df.distinct().orderBy("label").limit(SNAPSHOT[part] + 1).withColumn("position", F.row_number().over(Window.orderBy("label")))
        rows = top.select(F.lit(part).alias("part"), "position", "label", (F.col("position") > SNAPSHOT[part]).alias("beyond"))
        out = rows if out is None else out.unionByName(rows)
    return out
