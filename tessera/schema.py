"""Table schemas, status tiers and the checks that Spark does not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses by tier, in display order.
REVIEW, ENGINE, TERMINAL = ("candidate", "needs_review"), ("confirmed", "accepted"), ("superseded",)
STATUS_ORDER = REVIEW + ENGINE + TERMINAL
MIN_SOURCES = 2

FACTS = "id long, subject string, relation string, object string, status string, confidence double, source_id long, job_id long, note string, term_token string, stale boolean, created_at timestamp, updated_at timestamp"
SOURCES = "id long, path string, kind string, added_at timestamp"
JOBS = "id long, source_id long, artifact_id long, status string, provider string, model string, total_chunks long, completed_chunks long, failed_chunks long, candidate_count long, message string, created_at timestamp, updated_at timestamp"
CHUNKS = "id long, source_id long, job_id long, chunk_index long, text string, status string, attempts long, error string"
EVIDENCE = "id long, fact_id long, source_id long, artifact_id long, job_id long, chunk_id long, evidence_kind string, start_offset long, end_offset long, locator string, snippet string"
EVENTS = "id long, fact_id long, event_type string, actor string, source_id long, rule_name string, before_json string, after_json string, at timestamp"
SNIPPET_CHARS = 1000


def in_tier(tier: tuple[str, ...], status: str | Column = "status") -> Column:
    """Whether a status is in a tier. A tier without statuses is a mistake, never a filter to nothing."""
    if not tier:
        raise ValueError("an empty status tier")
    c = F.col(status) if isinstance(status, str) else status
    return c.isin(*sorted(tier))


def broken_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem) of facts that break a constraint: unknown status, confidence out of range, missing source."""
    at = facts.join(sources.select(F.col("id").alias("sid")), facts["source_id"] == F.col("sid"), "left")
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin(*STATUS_ORDER), F.lit(False)), F.lit("unknown_status")),
            F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence_out_of_range")),
            F.when(F.col("source_id").isNotNull() & F.col("sid").isNull(), F.lit("missing_source")),
        )
    )
    return at.select("id", F.explode(problems).alias("problem"))


def broken_evidence(evidence: DataFrame) -> DataFrame:
    """Ids of evidence whose offsets are half given, negative or reversed, or whose snippet is too long."""
    a, b = F.col("start_offset"), F.col("end_offset")
    bad = (a.isNull() != b.isNull()) | (a < 0) | (b < a) | (F.length("snippet") > SNIPPET_CHARS)
    return evidence.filter(F.coalesce(bad, F.lit(False))).select("id")
