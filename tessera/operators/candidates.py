"""Dry runs of candidate queries, and which of them answers its question.

What a planner proposes for questions is a short list on the driver. Everything that can be known without the facts
(a text that is no query, an expansion past its bound, a plan that Spark refuses) is the candidate's outcome at
once; all others are evaluated in one job, the union of their answers tagged with the candidate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..datalog import DatalogError, parse_program
from ..functions import text
from . import documents, engine

# Candidates of a question and answers of a candidate, at most; families that only discover labels.
MOST_CANDIDATES, MOST_ANSWERS = 32, 512
DISCOVERY = ("discovery", "subject_discovery", "object_discovery")
INVALID, FAILED, NONE, REVIEW, VALID = "invalid", "engine_policy_error", "no_answer", "review_required", "valid"


@dataclass
class Candidate:
    """A query as text, or as the frame of its answers where no text can state it. label: what discovery found."""

    family: str
    query: str
    answers: DataFrame | None = None
    label: str = ""


def _values(candidate: Candidate, relation: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """answer of a candidate; raises ValueError for a text that is no query, other errors where it can't run."""
    from .planner import BASE, expand_aliases

    if candidate.answers is not None:
        return candidate.answers.select(F.col("answer").cast("string").alias("answer"))
    if why := engine.check_query(candidate.query, relation):
        raise ValueError(why)
    program = expand_aliases(parse_program(BASE + candidate.query), aliases)
    frames = engine.evaluate(program, relation)
    found = [frames[n].select(text.render(F.col(d.columns[0]), "shown").alias("answer")) for n, d in program.declarations.items() if n.startswith(engine.QUERY_NAME)]
    return reduce(DataFrame.unionByName, found) if found else relation.sparkSession.createDataFrame([], "answer string")


def dry_run(proposed: list[tuple[int, Candidate]], relation: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """question, position, family, query, outcome, reason, n, answers of every candidate; nothing is stored.

    proposed: (question, candidate) in the planner's order, which position numbers from 0 within a question.
    relation: the engine's frame. answers are the distinct answers in order, MOST_ANSWERS at most; a candidate with
    more is up for review, as is every candidate of a question with more than MOST_CANDIDATES, and one of a
    discovery family whose label says too little. The job's rows are bounded by candidates, not by facts.
    """
    spark, known, frames, of = relation.sparkSession, [], [], {}
    for i, (question, c) in enumerate(proposed):
        position = of[question] = of.get(question, -1) + 1
        outcome = reason = None
        try:
            frames.append(_values(c, relation, aliases or {}).select(F.lit(i).alias("i"), "answer"))
        except (DatalogError, PySparkException) as e:
            outcome, reason = FAILED, str(e).partition("\n")[0]
        except ValueError as e:
            outcome, reason = INVALID, str(e)
        known.append((i, question, position, c.family, c.query, c.label, outcome, reason))
    schema = "i int, question long, position int, family string, query string, label string, outcome string, reason string"
    base = spark.createDataFrame(known, schema)
    said = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "i int, answer string")
    place = F.row_number().over(Window.partitionBy("i").orderBy("answer"))
    first = said.filter("answer is not null").distinct().withColumn("place", place).filter(F.col("place") <= MOST_ANSWERS + 1)
    held = first.groupBy("i").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("answer")).alias("answers"))
    at = base.join(F.broadcast(held), "i", "left")
    crowded = F.count("*").over(Window.partitionBy("question")) > MOST_CANDIDATES
    vague = F.col("family").isin(*DISCOVERY) & documents.low_signal("label")
    many = F.col("n") > MOST_ANSWERS
    outcome = F.coalesce("outcome", F.when(crowded, REVIEW).when(F.col("n").isNull(), NONE).when(many | vague, REVIEW).otherwise(VALID))
    reason = F.coalesce("reason", F.when(crowded, "more candidates than a plan holds").when(many, "more answers than a bound").when(vague & F.col("n").isNotNull(), "the relation label says too little"), F.lit(""))
    empty = F.expr("cast(array() as array<string>)")
    return at.select("question", "position", "family", "query", outcome.alias("outcome"), reason.alias("reason"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("answers", empty).alias("answers"))


def select_candidates(runs: DataFrame) -> DataFrame:
    """question, outcome, position, query, answers: what the dry runs of each question come to.

    One candidate that the engine could not run fails the question. Without answers it is up for review if some
    candidate is, invalid if all are, else it has no answer. With answers direct candidates go before discovery;
    the first of them is selected, and other answers in another of the same kind, or discovery from both sides,
    make the question ambiguous.
    """
    is_ = lambda o: F.col("outcome") == o
    direct = ~F.col("family").isin(*DISCOVERY)
    some = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    chosen = F.struct("position", "query", "answers")
    per = runs.groupBy("question").agg(
        some(is_(FAILED)).alias("failed"), some(is_(REVIEW)).alias("review"), F.min(is_(INVALID)).alias("invalid"),
        F.min_by(F.when(is_(VALID) & direct, chosen), F.when(is_(VALID) & direct, F.col("position"))).alias("d"),
        F.count_distinct(F.when(is_(VALID) & direct, F.col("answers"))).alias("nd"),
        F.min_by(F.when(is_(VALID) & ~direct, chosen), F.when(is_(VALID) & ~direct, F.col("position"))).alias("f"),
        F.count_distinct(F.when(is_(VALID) & ~direct, F.col("answers"))).alias("nf"),
        F.count_distinct(F.when(is_(VALID) & ~direct, F.col("family"))).alias("families"),
    )
    one = F.coalesce("d", "f")
    torn = F.when(F.col("d").isNotNull(), F.col("nd") > 1).otherwise((F.col("nf") > 1) | (F.col("families") > 1))
    none = F.when(F.col("review"), REVIEW).when(F.col("invalid"), INVALID).otherwise(NONE)
    outcome = F.when(F.col("failed"), FAILED).when(one.isNull(), none).when(torn, "ambiguous").otherwise(VALID)
    kept = lambda c: F.when(~F.col("failed"), one[c])
    return per.select("question", outcome.alias("outcome"), kept("position").alias("position"), kept("query").alias("query"), F.coalesce(kept("answers"), F.expr("cast(array() as array<string>)")).alias("answers"))
