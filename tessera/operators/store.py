"""Changes to the fact store as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENGINE, REVIEW, SNIPPET_CHARS, in_tier
from .analytics import latest_per


def token(subject="subject", relation="relation", obj="object"):
    """The coherence token of a triple of stored terms."""
    return F.sha2(F.concat_ws("\u001f", subject, relation, obj), 256)


def check_terms(facts: DataFrame, term_rows: DataFrame) -> DataFrame:
    """(id, problem) of engine facts whose stored terms are missing or have another token than they should."""
    t = term_rows.select("fact_id", token("subject", "rel", "object").alias("now"), F.col("term_token").alias("kept"))
    at = facts.filter(in_tier(ENGINE)).select("id").join(t, F.col("id") == F.col("fact_id"), "left")
    problem = F.when(F.col("fact_id").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("kept")), "token_mismatch")
    return at.select("id", problem.alias("problem")).filter("problem is not null")


def whole_terms(facts: DataFrame, term_rows: DataFrame) -> DataFrame:
    """id and the three stored terms of the engine facts whose terms are whole, for those who repair the others."""
    whole = term_rows.filter(token("subject", "rel", "object") == F.col("term_token")).select(F.col("fact_id").alias("id"), "subject", "rel", "object")
    return facts.filter(in_tier(ENGINE)).select("id").join(whole, "id")


def engine_terms(facts: DataFrame, term_rows: DataFrame) -> DataFrame:
    """id and the three stored terms of all engine facts. An action fails where some fact's terms are missing or have
    another token than they should: no rule ever runs over part of the facts.

    The guard is a filter with a value that is not deterministic, so it is neither pruned with the columns that it
    reads nor passed by a later filter: every engine fact is checked in every action.
    """
    t = term_rows.select("fact_id", "subject", "rel", "object", "term_token")
    at = facts.filter(in_tier(ENGINE)).select("id").join(t, F.col("id") == F.col("fact_id"), "left")
    problem = F.when(F.col("fact_id").isNull(), "are missing").otherwise("differ from their token")
    broken = F.raise_error(F.concat(F.lit("the stored terms of fact "), F.col("id").cast("string"), F.lit(" "), problem)).cast("boolean")
    sound = (F.monotonically_increasing_id() >= 0) & (token("subject", "rel", "object").eqNullSafe(F.col("term_token")) & F.col("fact_id").isNotNull())
    return at.filter(F.when(sound, True).otherwise(broken)).select("id", "subject", "rel", "object")


def _made_terms(facts: DataFrame) -> DataFrame:
    """Rows of the term table from the display labels of facts (fact_id, subject, relation, object), as strings."""
    from ..functions import text

    slot = lambda c: text.slot(F.lit("string"), F.col(c))["v"]
    made = facts.select("fact_id", slot("subject").alias("subject"), slot("relation").alias("rel"), slot("object").alias("object"))
    return made.withColumn("term_token", token("subject", "rel", "object"))


def backfill_terms(facts: DataFrame, term_rows: DataFrame) -> DataFrame:
    """Rows of term_rows for the engine facts without any, from their display labels as strings."""
    bare = facts.filter(in_tier(ENGINE)).select(F.col("id").alias("fact_id"), "subject", "relation", "object").join(term_rows.select("fact_id"), "fact_id", "left_anti")
    return _made_terms(bare)


def repaired_terms(facts: DataFrame, term_rows: DataFrame) -> DataFrame:
    """term_rows with what check_terms() names made anew from display labels; rows that are whole stay as they are.
    To write a fact's labels again is how a person mends it: this does it for all that are broken."""
    broken = check_terms(facts, term_rows).select(F.col("id").alias("fact_id"))
    labels = facts.select(F.col("id").alias("fact_id"), "subject", "relation", "object").join(broken, "fact_id", "left_semi")
    return term_rows.select("fact_id", "subject", "rel", "object", "term_token").join(broken, "fact_id", "left_anti").unionByName(_made_terms(labels))


def terms_by_ids(term_rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of the facts asked for, each once; unknown ids are left out. ids are the caller's own list."""
    return term_rows.filter(F.col("fact_id").isin(*set(ids))) if ids else term_rows.limit(0)


def lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows with these values, as of one id or path; null is a value like others."""
    for name, value in keys.items():
        table = table.filter(F.col(name).eqNullSafe(F.lit(value)))
    return table


def upsert_sources(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """path, kind, id and action of incoming sources (path, kind), each path once: insert, keep or change of kind.
    Of several kinds for one path the least counts."""
    fresh = incoming.groupBy("path").agg(F.min("kind").alias("kind"))
    at = fresh.join(stored.select("path", F.col("kind").alias("had"), "id"), "path", "left")
    return at.select("path", "kind", "id", F.when(F.col("had").isNull(), "insert").when(F.col("had") == F.col("kind"), "keep").otherwise("change").alias("action"))


def nfc_plan(labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """id, column, before, after of every label that is not in NFC. Applying it and taking it back are one join."""
    from ..functions import text

    long = labels.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("before")) for c in columns])).alias("x")).select("id", "x.*")
    odd = long.filter(F.rlike("before", F.lit(r"[^\x00-\x7F]")))
    return odd.withColumn("after", text.nfc(F.col("before"))).filter("before <> after")


def nfc_apply(labels: DataFrame, plan: DataFrame, columns: tuple[str, ...], back: bool = False) -> DataFrame:
    """labels with the plan's changes made, or taken back; a label that changed meanwhile is left alone."""
    old, new = ("after", "before") if back else ("before", "after")
    for c in columns:
        step = plan.filter(F.col("column") == c).select(F.col("id").alias("__id"), F.col(old).alias("__old"), F.col(new).alias("__new"))
        at = labels.join(step, (F.col("id") == F.col("__id")) & (F.col(c) == F.col("__old")), "left")
        labels = at.withColumn(c, F.coalesce("__new", c)).drop("__id", "__old", "__new")
    return labels


def staleness_sweep(facts: DataFrame, jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ids of engine facts that the newest complete analysis of their source no longer cites.

    A job gates its source only if it is the newest, done, without failed chunks, has an artifact, and at least
    one evidence row stands at that artifact. A fact falls if it has evidence with an artifact but none there.
    """
    last = latest_per(jobs, "source_id").filter((F.col("status") == "done") & (F.col("failed_chunks") == 0) & F.col("artifact_id").isNotNull())
    cited = evidence.filter(F.col("artifact_id").isNotNull())
    gates = last.select("source_id", "artifact_id").join(cited.select("source_id", "artifact_id").distinct(), ["source_id", "artifact_id"], "left_semi")
    engine = facts.filter(in_tier(ENGINE)).select("id", "source_id").join(gates, "source_id")
    with_any = engine.join(cited.select(F.col("fact_id").alias("id")).distinct(), "id", "left_semi")
    return with_any.join(cited.select(F.col("fact_id").alias("id"), "artifact_id").distinct(), ["id", "artifact_id"], "left_anti").select("id", "source_id", "artifact_id")


def apply_sweep(facts: DataFrame, swept: DataFrame) -> DataFrame:
    hit = swept.select("id", F.lit(True).alias("__hit"))
    at = facts.join(hit, "id", "left")
    return at.withColumn("status", F.when(F.col("__hit"), "needs_review").otherwise(F.col("status"))).withColumn("stale", F.col("stale") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def reconcile(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """Each incoming (source_id, subject, relation, object) once, with action insert, keep or suppress.

    Known means the same source and triple in any status; a live row wins over a superseded one, and a hit on
    superseded rows alone suppresses the insert.
    """
    k = ["source_id", "subject", "relation", "object"]
    known = facts.groupBy(*k).agg(F.max((F.col("status") != "superseded").cast("int")).alias("live"), F.min(F.when(F.col("status") != "superseded", F.col("id"))).alias("live_id"), F.min("id").alias("any_id"))
    at = incoming.select(*k).distinct().join(known.select(*[F.col(c).alias(f"k_{c}") for c in k], "live", "live_id", "any_id"), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in k], "left")
    action = F.when(F.col("live").isNull(), "insert").when(F.col("live") == 1, "keep").otherwise("suppress")
    return at.select(*k, action.alias("action"), F.coalesce("live_id", "any_id").alias("fact_id"))


def reconcile_terms(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """Each incoming (source_id, term_token, subject, relation, object) once, with action insert, keep or suppress,
    and the fact_id it meets.

    What a triple is its token says: terms that only look alike stay apart. Facts from before there were tokens
    have none; those alone are met by their display text. Of all that a triple meets, a live row goes before a
    superseded one, then the least id; a triple that meets superseded rows alone is suppressed. Both matches are
    keyed joins on pre-aggregated facts; null sources meet null sources.
    """
    best = F.min(F.struct((F.col("status") == "superseded").alias("dead"), F.col("id").alias("fact_id"))).alias("best")
    text = ["subject", "relation", "object"]
    tokens = facts.filter(F.col("term_token").isNotNull()).groupBy("source_id", "term_token").agg(best)
    legacy = facts.filter(F.col("term_token").isNull()).groupBy("source_id", *text).agg(best)
    at = incoming.select("source_id", "term_token", *text).distinct()

    def met(at, known, keys, name):
        side = known.select(*[F.col(k).alias("k_" + k) for k in keys], F.col("best").alias(name))
        return at.join(side, [F.col(k).eqNullSafe(F.col("k_" + k)) for k in keys], "left").drop(*["k_" + k for k in keys])

    at = met(met(at, tokens, ["source_id", "term_token"], "by_token"), legacy, ["source_id", *text], "by_text")
    hit = F.least("by_token", "by_text")
    action = F.when(hit.isNull(), "insert").when(hit["dead"], "suppress").otherwise("keep")
    return at.select("source_id", "term_token", *text, action.alias("action"), hit["fact_id"].alias("fact_id"))


def suppressions(reconciled: DataFrame) -> DataFrame:
    """One event for each superseded fact that a run saw again: nothing was inserted, and it says so."""
    hit = reconciled.filter(F.col("action") == "suppress").select("fact_id", "source_id").distinct()
    return hit.select("fact_id", "source_id", F.lit("reextraction_suppressed").alias("event_type"), F.lit("system").alias("actor"))


def batch_summary(reconciled: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, path and the facts a run inserted of each source it saw, those with none included."""
    n = reconciled.groupBy("source_id").agg(F.sum((F.col("action") == "insert").cast("long")).alias("inserted"))
    return n.join(sources.select(F.col("id").alias("source_id"), "path"), "source_id").select("source_id", "path", "inserted")


def seen_again(facts: DataFrame, observed: DataFrame) -> DataFrame:
    """facts with stale cleared where a fact_id of observed is seen again."""
    seen = observed.select(F.col("fact_id").alias("__seen")).distinct()
    at = facts.join(seen, F.col("id") == F.col("__seen"), "left")
    return at.withColumn("stale", F.col("stale") & F.col("__seen").isNull()).drop("__seen")


def reobserve(observed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact_id, artifact_id) pairs seen now that have no evidence yet."""
    k = ["fact_id", "artifact_id"]
    return observed.select(*k).distinct().join(evidence.select(*k).distinct(), k, "left_anti")


def repoint(table: DataFrame, merges: DataFrame, column: str = "source_id") -> DataFrame:
    """The table with references to merged sources led to the one kept."""
    m = merges.select(F.col("id").alias("__from"), F.col("kept_id").alias("__to"))
    return table.join(m, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def reanalyze_clear(facts: DataFrame, source_id: int) -> DataFrame:
    """Facts without the review tier of a source, which a new analysis fills again."""
    return facts.filter(~(F.col("source_id").eqNullSafe(F.lit(source_id)) & in_tier(REVIEW)))


def anchor_evidence(evidence: DataFrame) -> DataFrame:
    """The first evidence of each fact at each artifact, snippets cut to their bound."""
    first = evidence.groupBy("fact_id", "artifact_id").agg(F.min_by(F.struct("id", "source_id", "snippet"), "id").alias("e"))
    return first.select("fact_id", "artifact_id", F.col("e.id").alias("id"), F.col("e.source_id").alias("source_id"), F.substring("e.snippet", 1, SNIPPET_CHARS).alias("snippet"))
