"""Corroboration, conflicts, acceptance and trust labels.

Input facts carry canonical (see policy_files.canonicalize) and okey, the object's grouping key: a typed scalar
where the relation has a type and the object parses, else the raw object.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..schema import ENGINE, MIN_SOURCES, REVIEW, in_tier
from ..sources.policy_files import canonicalize


def with_keys(facts: DataFrame, aliases: DataFrame, specs: dict[str, dict] | None = None) -> DataFrame:
    """Adds canonical and okey. specs: canonical relation -> {type, units}."""
    at = canonicalize(facts, aliases)
    key = F.lit(None).cast("string")
    for relation, spec in (specs or {}).items():
        value = typed.typed_key(spec["type"], F.col("object"), spec.get("units")).cast("string")
        key = F.when(F.col("canonical") == relation, F.concat(F.lit(spec["type"] + ":"), value)).otherwise(key)
    return at.withColumn("okey", F.coalesce(key, F.concat(F.lit("raw:"), F.col("object"))))


def _sourced(keyed: DataFrame) -> DataFrame:
    return keyed.filter(in_tier(ENGINE) & F.col("source_id").isNotNull())


def corroboration(keyed: DataFrame) -> DataFrame:
    """subject, canonical, object (raw), n_sources, sources of engine facts with a source."""
    return _joined(_sourced(keyed).groupBy("subject", "canonical", "object").agg(F.collect_set("source_id").alias("s")))


def _joined(df: DataFrame) -> DataFrame:
    """The set s as a count and as text, ascending."""
    return df.withColumn("n_sources", F.size("s").cast("long")).withColumn("sources", F.array_join(F.transform(F.array_sort("s"), lambda x: x.cast("string")), ", ")).drop("s")


def single_valued_conflicts(keyed: DataFrame, functional: DataFrame) -> DataFrame:
    """Subjects with two or more values of a single-valued relation: one row a value, the least raw object for it."""
    f = functional.select(F.col("rel").alias("canonical"))
    values = _sourced(keyed).join(f, "canonical").groupBy("subject", "canonical", "okey").agg(F.min("object").alias("object"), F.collect_set("source_id").alias("s"))
    disputed = values.groupBy("subject", "canonical").agg(F.count("*").alias("n_values")).filter("n_values > 1")
    return _joined(values.join(disputed, ["subject", "canonical"])).drop("okey")


def workbench(keyed: DataFrame) -> DataFrame:
    """Values that two or more sources support, with the review candidates for the same value."""
    of = ["subject", "canonical", "okey"]
    strong = _sourced(keyed).groupBy(*of).agg(F.min("object").alias("object"), F.collect_set("source_id").alias("s"))
    waiting = keyed.filter(in_tier(REVIEW)).groupBy(*of).agg(F.collect_list("id").alias("w"))
    at = strong.filter(F.size("s") >= MIN_SOURCES).join(waiting, of, "left")
    ids = F.array_join(F.transform(F.array_sort(F.coalesce("w", F.expr("cast(array() as array<bigint>)"))), lambda x: x.cast("string")), ", ")
    return _joined(at.withColumn("candidates", ids)).select("subject", "canonical", "object", "n_sources", "sources", "candidates")


def conflict_groups(keyed: DataFrame, functional: DataFrame) -> DataFrame:
    """Subjects with two or more sourced values of a single-valued relation: how many values, and the review
    candidates for any of them. A group's candidates are its output: a person works through them."""
    disputed = single_valued_conflicts(keyed, functional).groupBy("subject", "canonical").agg(F.max("n_values").alias("n_values"))
    waiting = keyed.filter(in_tier(REVIEW)).join(disputed.select("subject", "canonical"), ["subject", "canonical"], "left_semi")
    listed = waiting.groupBy("subject", "canonical").agg(F.count("*").alias("n_candidates"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ", ").alias("candidates"))
    return disputed.join(listed, ["subject", "canonical"], "left").fillna({"n_candidates": 0, "candidates": ""})


# Reasons against acceptance, in their order.
REASONS = ["not_review_candidate", "source_missing", "source_analysis_incomplete", "previously_rejected_or_superseded", "insufficient_distinct_source_support", "single_valued_conflict", "stale_citation"]


def acceptance(keyed: DataFrame, jobs: DataFrame, events: DataFrame, functional: DataFrame) -> DataFrame:
    """id, status, support and reasons of every fact; no reasons means eligible.

    Support: distinct sources of review and engine facts of one value, without stale facts that need review and
    without review facts of a source whose own fact of that value was superseded (a shadow; facts without a source
    may shadow each other). A fact without a finished job is not analysed. A rival is any sourced review or engine
    fact with another value of the same single-valued relation; shadows and staleness don't silence it.
    Facts are grouped once by source and value; values, and the rivals of a subject, follow from these groups,
    which hold flags and counts alone. Facts are never paired, and no list of supporters is kept.
    """
    done = jobs.filter(F.col("status") == "done").select(F.col("id").alias("job_id"), F.lit(True).alias("ready"))
    refused = events.filter(F.col("event_type") == "rejected").select(F.col("fact_id").alias("id")).distinct().withColumn("refused", F.lit(True))
    f = keyed.join(done, "job_id", "left").fillna(False, ["ready"])
    value = ["subject", "canonical", "okey"]
    current = ~(F.col("stale") & (F.col("status") == "needs_review"))
    told = lambda tier, c: F.coalesce(F.max(F.when(in_tier(tier) & current, c)), F.lit(False))
    # One row a source and value. What its review facts add counts only where no superseded one shadows them.
    by_source = f.groupBy("source_id", *value).agg(
        F.max(F.col("status") == "superseded").alias("shadow"), F.max(in_tier(ENGINE) | in_tier(REVIEW)).alias("live"),
        told(ENGINE, F.lit(True)).alias("engine"), told(REVIEW, F.lit(True)).alias("review"),
        told(ENGINE, ~F.col("ready")).alias("engine_waits"), told(REVIEW, ~F.col("ready")).alias("review_waits"),
    )
    open_ = ~F.col("shadow")
    sourced = by_source.filter("source_id is not null").select(
        *value, "live", (F.col("engine") | (F.col("review") & open_)).alias("counted"), (F.col("engine_waits") | (F.col("review_waits") & open_)).alias("waits")
    )
    per_value = sourced.groupBy(*value).agg(F.sum(F.col("counted").cast("long")).alias("support"), F.max("waits").alias("unready"), F.max("live").alias("value_live"))
    rivals = per_value.filter("value_live").groupBy("subject", "canonical").agg(F.count("*").alias("live_values"))
    # What groups know of each other is joined among groups, so facts meet one table: the row of their own group.
    known = by_source.select("source_id", *value, (F.col("shadow") & F.expr(" and ".join(f"{c} is not null" for c in value))).alias("shadow"))
    known = known.join(per_value, value, "left").join(rivals, ["subject", "canonical"], "left")
    known = known.select(*[F.col(c).alias("g_" + c) for c in ["source_id", *value]], "shadow", "support", "unready", "value_live", "live_values")
    own = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("g_" + c)) for c in ["source_id", *value]])
    at = f.join(refused, "id", "left").join(known, own, "left").join(functional.select(F.col("rel").alias("canonical"), F.lit(True).alias("single")), "canonical", "left")
    at = at.fillna(False, ["refused", "shadow", "unready", "value_live"]).fillna(0, ["support", "live_values"])
    others = F.col("live_values") - F.col("value_live").cast("long")
    no = [
        ~in_tier(REVIEW),
        F.col("source_id").isNull(),
        ~F.col("ready") | F.col("unready"),
        (F.col("status") == "superseded") | F.col("refused") | F.col("shadow"),
        F.col("support") < MIN_SOURCES,
        F.coalesce("single", F.lit(False)) & (others > 0),
        F.col("stale") & (F.col("status") == "needs_review"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, r in zip(no, REASONS, strict=True)]))
    return at.select("id", "status", "support", F.array_join(reasons, ", ").alias("reasons"))


def apply_acceptance(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """facts after one automatic pass: eligible ones accepted, accepted ones short of support back to review.
    Both are judged on the same snapshot, so no fact moves twice."""
    j = judged.select("id", "support", "reasons")
    at = facts.join(j, "id", "left")
    status = F.when(F.col("reasons") == "", "accepted").when((F.col("status") == "accepted") & (F.col("support") < MIN_SOURCES), "needs_review").otherwise(F.col("status"))
    event = F.when(status == F.col("status"), None).when(status == "accepted", "auto_accept_applied").otherwise("auto_accept_retracted")
    return at.withColumn("event", event).withColumn("status", status).drop("support", "reasons")


def trust_labels(keyed: DataFrame, functional: DataFrame) -> DataFrame:
    """id and labels of every engine fact: corroborated or single_source or no_source, and conflicting."""
    value = ["subject", "canonical", "okey"]
    engine = keyed.filter(in_tier(ENGINE))
    support = _sourced(keyed).groupBy(*value).agg(F.count_distinct("source_id").alias("n"))
    disputed = single_valued_conflicts(keyed, functional).select("subject", "canonical").distinct().withColumn("disputed", F.lit(True))
    at = engine.join(support, value, "left").join(disputed, ["subject", "canonical"], "left")
    n = F.coalesce("n", F.lit(0))
    labels = F.array_compact(F.array(F.when(n >= MIN_SOURCES, "corroborated").when(n == 1, "single_source").otherwise("no_source"), F.when(F.col("disputed"), "conflicting")))
    return at.select("id", F.array_join(labels, ", ").alias("labels"))
