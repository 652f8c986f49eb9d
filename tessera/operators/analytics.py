"""Counts, coverage, queues, latest rows and lookups over the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENGINE, REVIEW, in_tier

# Confidence buckets, review page sizes and their default.
BUCKETS = ((0.5, "<0.5"), (0.7, "0.5–0.7"), (0.9, "0.7–0.9"))
TOP_BUCKET = "≥0.9"
PAGE_SIZES, PAGE_SIZE = (25, 50, 100), 50


def count_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n), the most frequent first, ties by value; the top k only where k is the report's size."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def by_confidence(facts: DataFrame) -> DataFrame:
    c = F.col("confidence")
    bucket = F.when(c < BUCKETS[0][0], BUCKETS[0][1]).when(c < BUCKETS[1][0], BUCKETS[1][1]).when(c < BUCKETS[2][0], BUCKETS[2][1]).otherwise(TOP_BUCKET)
    return facts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def with_source(facts: DataFrame, sources: DataFrame) -> DataFrame:
    return facts.join(sources.select(F.col("id").alias("__sid"), F.col("path").alias("source_path")), F.col("source_id") == F.col("__sid"), "left").drop("__sid")


def by_source(facts: DataFrame, sources: DataFrame, top: int = 20) -> DataFrame:
    """Counts per source path; facts without a known source count as (none). Counted by id before the join."""
    counted = facts.groupBy("source_id").agg(F.count("*").alias("c"))
    return with_source(counted, sources).groupBy(F.coalesce("source_path", F.lit("(none)")).alias("source")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "source").limit(top)


def coverage(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source with its facts and engine-tier facts; gap: none of them is in the engine tier."""
    counted = facts.groupBy("source_id").agg(F.count("*").alias("total"), F.sum(in_tier(ENGINE).cast("long")).alias("engine"))
    at = sources.join(counted, sources["id"] == F.col("source_id"), "left")
    total, engine = F.coalesce("total", F.lit(0)), F.coalesce("engine", F.lit(0))
    return at.select("id", "path", total.alias("total"), engine.alias("engine"), (engine == 0).alias("gap"))


def orphans(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose backing file is in no listing of files(path)."""
    return sources.join(files.select("path").distinct(), "path", "left_anti")


def latest_per(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The row with the greatest order in each group: max_by pre-aggregates, so a hot group is no hot task."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def sources_overview(facts: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    counted = facts.groupBy("source_id").agg(F.count("*").alias("facts"), F.sum(in_tier(REVIEW).cast("long")).alias("review"), F.sum(in_tier(ENGINE).cast("long")).alias("engine"))
    last = latest_per(jobs, "source_id").select("source_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    s = sources.select(F.col("id").alias("sid"), "path")
    at = s.join(counted, s["sid"] == counted["source_id"], "left").drop("source_id").join(last, F.col("sid") == last["source_id"], "left")
    return at.select(F.col("sid").alias("id"), "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "review", "engine")], "job_id", "job_status")


def facts_by_ids(facts: DataFrame, ids: list[int]) -> DataFrame:
    """Rows in the order asked for, repeats included; unknown ids are left out. ids are the caller's own list."""
    wanted = facts.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id long")
    return wanted.join(facts, "id").orderBy("pos")


def _order(name: str):
    ascii_lower = F.translate("source_path", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    orders = {
        "newest": [F.desc("id")],
        "oldest": [F.asc("id")],
        "updated": [F.desc("updated_at"), F.desc("id")],
        "confidence": [F.desc("confidence"), F.desc("id")],
        "source": [F.col("source_path").isNull().asc(), ascii_lower.asc(), F.desc("id")],
    }
    return orders.get(name, orders["newest"])


def review_page(facts: DataFrame, sources: DataFrame, order: str = "newest", page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of the review queue; unknown orders are newest first, unknown sizes the default."""
    size = size if size in PAGE_SIZES else PAGE_SIZE
    queue = with_source(facts.filter(in_tier(REVIEW)), sources)
    return queue.orderBy(*_order(order)).offset((max(page, 1) - 1) * size).limit(size)


def clamp_page(page: int, total: int, size: int) -> int:
    return min(max(page, 1), max(1, -(-total // size)))


def evidence_view(evidence: DataFrame, sources: DataFrame, artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence with its source's path, and its artifact's path and chunk's place where there are such."""
    s = sources.select(F.col("id").alias("source_id"), "path")
    a = artifacts.select(F.col("id").alias("artifact_id"), F.col("path").alias("artifact_path"))
    c = chunks.select(F.col("id").alias("chunk_id"), "chunk_index")
    at = evidence.join(s, "source_id").join(a, "artifact_id", "left").join(c, "chunk_id", "left")
    return at.select("id", "fact_id", "path", "artifact_id", "artifact_path", "chunk_index", "snippet")


def review_ids(facts: DataFrame, sources: DataFrame, order: str = "newest") -> DataFrame:
    """The ids of the whole review queue in its order."""
    return with_source(facts.filter(in_tier(REVIEW)), sources).orderBy(*_order(order)).select("id")


def distinct_with_events(events: DataFrame, types: list[str]) -> DataFrame:
    """One row: n, the distinct facts with an event of the types; no types give 0."""
    wanted = events.filter(F.col("event_type").isin(*types)) if types else events.limit(0)
    return wanted.agg(F.count_distinct("fact_id").alias("n"))


def distinct_snippets(evidence: DataFrame, top: int = 20) -> DataFrame:
    return evidence.groupBy("snippet").agg(F.min("id").alias("first_id")).orderBy("first_id").limit(top)


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """Chunk counts of each job and the status that follows from them."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    agg = chunks.groupBy("job_id").agg(F.count("*").alias("total"), n("done").alias("done"), n("failed").alias("failed"), n("running").alias("running"))
    final = F.col("done") + F.col("failed") == F.col("total")
    status = (
        F.when(final & (F.col("failed") > 0), "failed")
        .when(final | ((F.col("total") > 0) & (F.col("done") == F.col("total"))), "done")
        .when(F.col("running") > 0, "running")
        .when(F.col("failed") > 0, "failed")
        .otherwise("pending")
    )
    return agg.withColumn("status", status)


def exhausted_chunks(chunks: DataFrame, budget: int = 3) -> DataFrame:
    failed = chunks.filter(F.col("status") == "failed")
    return failed.groupBy("job_id").agg(F.count("*").alias("failed"), F.sum((F.col("attempts") >= budget).cast("long")).alias("exhausted"))


def next_pending(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("status") == "pending").groupBy("job_id").agg(F.min_by("id", "chunk_index").alias("chunk_id"))


def plan_extraction(jobs: DataFrame, chunks: DataFrame, budget: int = 3) -> DataFrame:
    """What to do with each source's newest job: fresh, busy, exhausted, retry or resume."""
    last = latest_per(jobs, "source_id").select("source_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    n = lambda c: F.sum(c.cast("long"))
    s = F.col("status")
    c = chunks.groupBy("job_id").agg(n(s == "done").alias("done"), n(s == "failed").alias("failed"), n((s == "failed") & (F.col("attempts") >= budget)).alias("spent"))
    at = last.join(c, "job_id", "left").fillna(0, ["done", "failed", "spent"])
    j = F.col("job_status")
    plan = (
        F.when(j == "running", "busy")
        .when(~j.isin("pending", "failed"), "fresh")
        .when(F.col("spent") > 0, "exhausted")
        .when(F.col("failed") > 0, "retry")
        .when(F.col("done") == 0, "fresh")
        .when(j == "pending", "resume")
        .otherwise("retry")
    )
    return at.select("source_id", "job_id", plan.alias("plan"))


def schema_profile(relation: DataFrame, examples: int = 3) -> DataFrame:
    """Each relation's facts, distinct subjects and objects, and the most frequent of both as examples."""
    sizes = relation.groupBy("rel").agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))
    rank = F.row_number().over(Window.partitionBy("rel").orderBy(F.desc("n"), "label"))

    def shown(column: str, name: str) -> DataFrame:
        top = relation.groupBy("rel", F.col(column).alias("label")).agg(F.count("*").alias("n")).withColumn("k", rank).filter(F.col("k") <= examples)
        return top.groupBy("rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ").alias(name))

    at = sizes.join(shown("subject", "subject_examples"), "rel").join(shown("object", "object_examples"), "rel")
    return at.withColumn("truncated", F.greatest("objects", "subjects") > examples)


def vocabulary(relation: DataFrame) -> DataFrame:
    """All entity surfaces and relation labels: kind, label."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in (("entity", "subject"), ("entity", "object"), ("relation", "rel"))])
    return relation.select(F.explode(pairs).alias("p")).select("p.kind", "p.label").distinct()
