"""Review decisions, extraction jobs and repair leases as pure functions from tables to tables.

Each function takes the tables as they stand and returns them as they stand after it; guards on the status that a
row has make a repeated call change nothing. Many jobs or facts change at once: commands are tables too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENGINE, REVIEW, in_tier
from .analytics import chunk_progress, next_pending

#: Attempts a chunk has, and seconds a lease lasts.
BUDGET, LEASE_SECONDS = 3, 30
CONTENT = ("subject", "relation", "object")


# -- review ------------------------------------------------------------------------------------------------------


def review(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts (id, status, subject, relation, object) after all decisions, with log: what each real change did.

    decisions: id, fact_id, action (toggle, accept, reject, amend), observed (the status seen when deciding, or
    null), and for amend the new subject, relation and object (null keeps the old). They apply in order of id. A
    decision whose observed status no longer holds does nothing; nothing leaves superseded, and it is not amended.
    log: array of decision, action, before, after (status for the first three, content for amend). The decisions on
    one fact are one group: people make them, so they are few.
    """
    d = F.struct("id", "action", "observed", *[F.col(c).alias("new_" + c) for c in CONTENT])
    per = decisions.groupBy("fact_id").agg(F.array_sort(F.collect_list(d)).alias("ds"))
    at = facts.select("id", "status", *CONTENT).join(per, F.col("id") == F.col("fact_id"), "left")
    said = lambda s: F.concat_ws(" | ", *[s[c] for c in CONTENT])
    empty = F.expr("cast(array() as array<struct<decision:bigint,action:string,before:string,after:string>>)")

    def step(acc, d):
        now = acc["status"]
        dead = (now == "superseded") | (d["observed"].isNotNull() & (d["observed"] != now))
        to = (
            F.when(dead, now)
            .when(d["action"] == "reject", "superseded")
            .when((d["action"] == "toggle") & in_tier(ENGINE, now), "needs_review")
            .when(d["action"].isin("toggle", "accept") & in_tier(REVIEW, now), "confirmed")
            .otherwise(now)
        )
        amends = ~dead & (d["action"] == "amend")
        new = F.struct(*[F.when(amends, F.coalesce(d["new_" + c], acc[c])).otherwise(acc[c]).alias(c) for c in CONTENT])
        before, after = F.when(amends, said(acc)).otherwise(now), F.when(amends, said(new)).otherwise(to)
        entry = F.struct(d["id"].alias("decision"), d["action"].alias("action"), before.alias("before"), after.alias("after"))
        log = F.when(before != after, F.array_append(acc["log"], entry)).otherwise(acc["log"])
        return F.struct(to.alias("status"), *[new[c].alias(c) for c in CONTENT], log.alias("log"))

    start = F.struct("status", *CONTENT, empty.alias("log"))
    out = F.when(F.col("ds").isNull(), start).otherwise(F.aggregate("ds", start, step))
    return at.select("id", out.alias("r")).select("id", "r.status", *["r." + c for c in CONTENT], "r.log")


def review_log(reviewed: DataFrame) -> DataFrame:
    """One row a change: fact_id, decision, action, before, after."""
    return reviewed.select(F.col("id").alias("fact_id"), F.explode("log").alias("e")).select("fact_id", "e.*")


def bulk_accept(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Decisions that accept the chosen facts (id, observed) still in review as they were seen; others are left out."""
    at = facts.filter(in_tier(REVIEW)).select("id", "status").join(chosen.select("id", "observed").distinct(), "id")
    held = at.filter(F.col("observed").isNull() | (F.col("observed") == F.col("status")))
    none = [F.lit(None).cast("string").alias(c) for c in CONTENT]
    return held.select("id", F.col("id").alias("fact_id"), F.lit("accept").alias("action"), F.col("status").alias("observed"), *none)


# -- extraction jobs ---------------------------------------------------------------------------------------------


def claim(chunks: DataFrame) -> DataFrame:
    """The next pending chunk of each job running, its attempt counted; a job with a running chunk claims none."""
    busy = chunks.filter(F.col("status") == "running").select("job_id").distinct()
    mine = next_pending(chunks).join(busy, "job_id", "left_anti").select(F.col("chunk_id").alias("claimed"))
    at = chunks.join(mine, F.col("id") == F.col("claimed"), "left")
    hit = F.col("claimed").isNotNull()
    return at.withColumns({"status": F.when(hit, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("long")}).drop("claimed")


def finish(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Running chunks done or failed as results (chunk_id, ok) say; results of other chunks come too late."""
    at = chunks.join(results.groupBy("chunk_id").agg(F.min("ok").alias("ok")), F.col("id") == F.col("chunk_id"), "left")
    status = F.when((F.col("status") == "running") & F.col("ok").isNotNull(), F.when(F.col("ok"), "done").otherwise("failed")).otherwise(F.col("status"))
    return at.withColumn("status", status).drop("chunk_id", "ok")


def retry(chunks: DataFrame, jobs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Failed chunks of the jobs (job_id) pending again while they have attempts left."""
    at = chunks.join(jobs.select("job_id").distinct().withColumn("again", F.lit(True)), "job_id", "left")
    hit = F.coalesce("again", F.lit(False)) & (F.col("status") == "failed") & (F.col("attempts") < budget)
    return at.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).drop("again")


def requeue(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running chunks of the jobs, whose worker is gone, pending again; the attempt is given back, never below 0."""
    at = chunks.join(jobs.select("job_id").distinct().withColumn("again", F.lit(True)), "job_id", "left")
    hit = F.coalesce("again", F.lit(False)) & (F.col("status") == "running")
    given = F.when(hit, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    return at.withColumns({"attempts": given, "status": F.when(hit, "pending").otherwise(F.col("status"))}).drop("again")


def roll_up(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs with the counts and status that follow from their chunks; those without chunks stay as they are."""
    p = chunk_progress(chunks).select(F.col("job_id").alias("__job"), "total", "done", "failed", F.col("status").alias("now"))
    at = jobs.join(p, F.col("id") == F.col("__job"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return at.select("id", F.coalesce("now", "status").alias("status"), n("total").alias("total_chunks"), n("done").alias("completed_chunks"), n("failed").alias("failed_chunks"))


def job_listing(jobs: DataFrame, sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs with their source's and artifact's paths, the newest first; a job without its source is not listed."""
    s = sources.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    a = artifacts.select(F.col("id").alias("artifact_id"), F.col("path").alias("artifact_path"))
    return jobs.join(s, "source_id").join(a, "artifact_id", "left").select("id", "status", "source_path", "artifact_path").orderBy(F.desc("id"))


# -- repairs -----------------------------------------------------------------------------------------------------


def repair_progress(items: DataFrame) -> DataFrame:
    """Items of each repair job by how they ended."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return items.groupBy("job_id").agg(F.count("*").alias("total"), n("done"), n("skipped"), n("failed"))


def expired(repairs: DataFrame, now: int) -> DataFrame:
    """Running repairs whose lease has run out."""
    return repairs.filter((F.col("status") == "running") & (F.col("lease_until") < now))


def lease(repairs: DataFrame, owner: str, now: int, seconds: int = LEASE_SECONDS) -> DataFrame:
    """The oldest repair that waits or whose lease ran out goes to the owner, unless one with a lease is running."""
    live = repairs.filter((F.col("status") == "running") & (F.col("lease_until") >= now)).agg(F.count("*").alias("live"))
    free = repairs.filter((F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now))).agg(F.min("id").alias("mine"))
    at = repairs.crossJoin(F.broadcast(live)).crossJoin(F.broadcast(free))  # one row each
    hit = (F.col("live") == 0) & (F.col("id") == F.col("mine"))
    changed = {"status": "running", "owner": owner, "lease_until": now + seconds}
    return at.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changed.items()}).drop("live", "mine")


def heartbeat(repairs: DataFrame, owner: str, now: int, seconds: int = LEASE_SECONDS) -> DataFrame:
    """A lease goes on while its owner asks in time; a lost one stays lost."""
    mine = (F.col("status") == "running") & (F.col("owner") == owner) & (F.col("lease_until") >= now)
    return repairs.withColumn("lease_until", F.when(mine, F.lit(now + seconds)).otherwise(F.col("lease_until")))


def end_repair(repairs: DataFrame, owner: str, now: int, status: str = "done") -> DataFrame:
    """The owner's running repairs end; another owner's, and those whose lease ran out, do not."""
    mine = (F.col("status") == "running") & (F.col("owner") == owner) & (F.col("lease_until") >= now)
    return repairs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "lease_until": F.when(mine, None).otherwise(F.col("lease_until"))})


# -- questions ---------------------------------------------------------------------------------------------------

# How a candidate evaluation leaves its question.
OUTCOMES = {"valid": "translated", "no_answer": "no_answer", "ambiguous": "ambiguous", "review_required": "review_required", "invalid": "translation_failed", "engine_policy_error": "translation_failed"}


def translate(questions: DataFrame, results: DataFrame, again: bool = False) -> DataFrame:
    """questions (id, status, query_dl, reason) after results (question_id, outcome, query, reason).

    Only pending questions change, or with again all but translated ones; an unknown outcome fails. A question
    that has no query in the end keeps none of an earlier one. Of several results of a question the least counts,
    by outcome, query and reason.
    """
    least = results.groupBy("question_id").agg(F.min(F.struct("outcome", "query", "reason")).alias("r"))
    r = least.select(F.col("question_id").alias("__q"), "r.outcome", F.col("r.query").alias("__query"), F.col("r.reason").alias("__reason"))
    at = questions.join(r, F.col("id") == F.col("__q"), "left")
    book = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    free = F.col("status") != "translated" if again else F.col("status") == "pending"
    hit = free & F.col("__q").isNotNull()
    to = F.coalesce(F.try_element_at(book, F.col("outcome")), F.lit("translation_failed"))
    new = {"status": to, "query_dl": F.when(to == "translated", F.col("__query")), "reason": F.coalesce("__reason", F.lit(""))}
    return at.select("id", *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in new.items()])
