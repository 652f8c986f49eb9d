"""Rules as DataFrames. Each predicate is one lazy frame; Catalyst sees a whole program as one plan.

A frame of predicate p(a, b) has columns a, __cmp_a, b, __cmp_b: stored value and compare key. Joins, constants
and comparisons use keys; values ride along. A predicate without columns has the one column __present.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from ..datalog import Comparison, DatalogError, Declaration, Literal, Program, Rule, parse_program, stratify, validate
from ..functions import text

BASE = ("subject", "rel", "object")
PREFIXES = {"error_": "ERROR", "warn_": "WARN"}


def columns_of(d: Declaration) -> list[str]:
    return [x for c in d.columns for x in (c, f"__cmp_{c}")] or ["__present"]


def base_relation(facts: DataFrame, plain: bool = False) -> DataFrame:
    """The relation frame of subject, relation, object strings. plain: all labels are printable ASCII without
    quotes or backslashes, so that keys need no UDF."""
    slot = (lambda c: text.string_term(c)) if plain else (lambda c: text.slot(F.lit("string"), c))
    made = facts.select(*[slot(F.col(a)).alias(b) for a, b in zip(("subject", "relation", "object"), BASE, strict=True)])
    return dedupe(made.select(*[F.col(f"{c}.{x}").alias(n) for c in BASE for x, n in (("v", c), ("cmp", f"__cmp_{c}"))]), BASE)


def dedupe(df: DataFrame, columns) -> DataFrame:
    """One row for each tuple of keys, with the least values."""
    if not columns:
        return df.distinct()
    grouped = df.groupBy(*[f"__cmp_{c}" for c in columns]).agg(*[F.min(c).alias(c) for c in columns])
    return grouped.select(*[x for c in columns for x in (c, f"__cmp_{c}")])


def fact_frame(spark: SparkSession, d: Declaration, facts: list[Literal]) -> DataFrame | None:
    """Rows that a program states itself: small, by the program's own length."""
    if not facts:
        return None
    if not d.columns:
        return spark.range(1).select(F.lit(True).alias("__present"))
    rows = sorted({tuple(x for a in f.args for x in (terms.to_json(a), terms.key(a))) for f in facts})
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns_of(d)))


def empty_frame(spark: SparkSession, d: Declaration) -> DataFrame:
    kind = "string" if d.columns else "boolean"
    return spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c in columns_of(d)))


@dataclass
class _Bindings:
    """Where each variable's value and key stand."""

    at: dict[str, tuple[Column, Column]] = field(default_factory=dict)

    def pair(self, t) -> tuple[Column, Column]:
        if isinstance(t, terms.Var):
            return self.at[t.name]
        if not terms.is_ground(t):
            raise DatalogError("compounds with variables are not supported")
        return F.lit(terms.to_json(t)), F.lit(terms.key(t))


def _order(literals: list[Literal]) -> list[Literal]:
    """Most shared variables next, then most constants; unconnected ones last."""
    left, out, bound = list(literals), [], set()
    while left:
        pick = max(left, key=lambda x: (len({a.name for a in x.args if isinstance(a, terms.Var)} & bound), sum(not isinstance(a, terms.Var) for a in x.args), -left.index(x)))
        left.remove(pick)
        out.append(pick)
        bound |= {a.name for a in pick.args if isinstance(a, terms.Var)}
    return out


def _atom(x: Literal, d: Declaration, frame: DataFrame, i: int) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """A literal's rows with columns of their own names, its constants and repeated variables applied."""
    if not d.columns:
        return frame.select(F.lit(True).alias(f"a{i}")), {}
    df = frame.select(*[F.col(f"`{n}`").alias(f"a{i}_{j}") for j, n in enumerate(columns_of(d))])
    places: dict[str, tuple[str, str]] = {}
    for j, a in enumerate(x.args):
        value, key = f"a{i}_{2 * j}", f"a{i}_{2 * j + 1}"
        if isinstance(a, terms.Var):
            if a.name in places:
                df = df.filter(F.col(places[a.name][1]) == F.col(key))
            else:
                places[a.name] = (value, key)
        elif terms.is_ground(a):
            df = df.filter(F.col(key) == F.lit(terms.key(a)))
        else:
            raise DatalogError("compounds with variables are not supported")
    return df, places


def compile_rule(rule: Rule, declarations: dict[str, Declaration], frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """The rows a rule derives. Joins are equi-joins on shared variables; literals that share none are crossed,
    as the language allows it."""
    waiting = rule.comparisons
    bindings, df = _Bindings(), None

    def apply_ready(df):
        nonlocal waiting
        ready = [c for c in waiting if all(v in bindings.at for t in (c.left, c.right) for v in terms.variables(t))]
        waiting = [c for c in waiting if c not in ready]
        for c in ready:
            a, b = bindings.pair(c.left)[1], bindings.pair(c.right)[1]
            df = df.filter(a == b if c.equal else a != b)
        return df

    for i, x in enumerate(_order(rule.literals)):
        side, places = _atom(x, declarations[x.name], frames[x.name], i)
        shared = [n for n in places if n in bindings.at]
        if df is None:
            df = side
        elif shared:
            df = df.join(side, reduce(lambda p, q: p & q, [bindings.at[n][1] == F.col(places[n][1]) for n in shared]))
        else:
            df = df.crossJoin(side)
        for n, (value, key) in places.items():
            bindings.at.setdefault(n, (F.col(value), F.col(key)))
        df = apply_ready(df)
    if df is None:
        df = apply_ready(spark.range(1))
    d = declarations[rule.head.name]
    out = [x for a, c in zip(rule.head.args, d.columns, strict=True) for x in (bindings.pair(a)[0].alias(c), bindings.pair(a)[1].alias(f"__cmp_{c}"))]
    return df.select(*(out or [F.lit(True).alias("__present")]))


def evaluate(program: Program, relation: DataFrame) -> dict[str, DataFrame]:
    """A lazy frame for each declared predicate. Only what an action reads is ever computed."""
    spark = relation.sparkSession
    validate(program)
    base = program.declarations.get("relation")
    if base is None or base.columns != BASE:
        raise DatalogError("the program must declare relation(subject: symbol, rel: symbol, object: symbol)")
    if any(f.name == "relation" for f in program.facts):
        raise DatalogError("a program states no facts of relation")
    if any(r.head.name == "relation" for r in program.rules):
        raise DatalogError("a program derives no rows of relation")
    frames = {"relation": relation}
    for name, d in program.declarations.items():
        if name != "relation":
            frames[name] = fact_frame(spark, d, [f for f in program.facts if f.name == name]) or empty_frame(spark, d)
    for name in stratify(program):
        d = program.declarations[name]
        parts = [compile_rule(r, program.declarations, frames, spark) for r in program.rules if r.head.name == name]
        if any(f.name == name for f in program.facts):
            parts.append(frames[name])
        frames[name] = dedupe(reduce(DataFrame.unionByName, parts), d.columns)
    return frames


def findings(program: Program, frames: dict[str, DataFrame]) -> DataFrame:
    """severity, code, text, columns, values of every row of an error_ or warn_ predicate."""
    spark = frames["relation"].sparkSession
    out = []
    for name in sorted(program.declarations):
        prefix = next((p for p in PREFIXES if name.startswith(p)), None)
        if prefix is None:
            continue
        cols, code = program.declarations[name].columns, name.removeprefix(prefix)
        values = F.array(*[text.render(F.col(c), "shown") for c in cols]) if cols else F.expr("cast(array() as array<string>)")
        rows = frames[name].select(values.alias("values"))
        said = F.concat(F.lit(f"{PREFIXES[prefix]} {code}: "), text.join_columns(F.col("values"))) if cols else F.lit(f"{PREFIXES[prefix]} {code}:")
        out.append(rows.select(F.lit(PREFIXES[prefix]).alias("severity"), F.lit(code).alias("code"), said.alias("text"), F.array(*map(F.lit, cols)).cast("array<string>").alias("columns"), "values"))
    schema = "severity string, code string, text string, columns array<string>, values array<string>"
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def answers(program: Program, frames: dict[str, DataFrame]) -> DataFrame:
    """qid, answer: the sorted distinct answers of each answer_q<id> predicate, joined by commas."""
    spark = frames["relation"].sparkSession
    rows = []
    for name in sorted(program.declarations):
        if name.startswith("answer_q"):
            cols = program.declarations[name].columns
            shown = text.join_columns(F.array(*[text.render(F.col(c), "answer") for c in cols]))
            rows.append(frames[name].select(F.lit(name.removeprefix("answer_q")).alias("qid"), shown.alias("value")))
    if not rows:
        return spark.createDataFrame([], "qid string, answer string")
    every = reduce(DataFrame.unionByName, rows).distinct()
    return every.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("answer")).orderBy(F.expr("try_cast(qid as decimal(38,0))").asc_nulls_last(), "qid")


def policy_labels(program: Program) -> list[str]:
    """Relation labels that a program's facts and rule bodies name as strings in columns called rel."""
    derived = {r.head.name for r in program.rules}
    found = set()
    for x in [*program.facts, *[y for r in program.rules for y in r.literals]]:
        if x.name in derived or x.name.startswith(("error_", "warn_", "answer_q")):
            continue
        for c, a in zip(program.declarations[x.name].columns, x.args, strict=True):
            if c == "rel" and isinstance(a, terms.Str):
                found.add(a.value)
    return sorted(found)


def dead_labels(program: Program, relation: DataFrame) -> DataFrame:
    """Labels the policy names but no fact has; none while there are no facts."""
    spark = relation.sparkSession
    wanted = spark.createDataFrame([(x, "s:" + terms.nfc(x)) for x in policy_labels(program)], "label string, k string")
    present = relation.select(F.col("__cmp_rel").alias("k")).distinct()
    return wanted.join(present, "k", "left_anti").join(relation.limit(1).select(F.lit(True).alias("any")), how="left_semi").select("label")


#: Findings of a report, at most.
MOST_FINDINGS = 10_000


@dataclass
class Report:
    ok: bool
    errors: list[str]
    warnings: list[str]
    answers: dict[str, str]
    rows: list[tuple]
    truncated: bool = False

    def text(self) -> str:
        head = "consistent" if self.ok else "inconsistent"
        lines = [f"{head}: {len(self.errors)} errors, {len(self.warnings)} warnings", *self.errors, *self.warnings]
        more = ["(there are more findings)"] if self.truncated else []
        return "\n".join([*lines, *more, *[f"ANSWER q{q}: {a}" for q, a in self.answers.items()]])


def run_check(relation: DataFrame, policy: str, query: str = "", rows: DataFrame | None = None) -> Report:
    """Evaluates policy and query over a relation frame. A program that cannot run is an error of the report.
    The report is for a person: at most MOST_FINDINGS findings are read, in their order, and truncated says that
    there are more. rows: see annotate()."""
    try:
        program = parse_program(policy + "\n" + query)
        frames = evaluate(program, relation)
    except DatalogError as e:
        return Report(False, [f"ERROR engine: {e}"], [], {}, [])
    found = findings(program, frames).distinct()
    if rows is not None:
        found = annotate(found, rows).withColumn("text", F.concat_ws(" ", "text", "note"))
    found = found.orderBy("severity", "text").limit(MOST_FINDINGS + 1).collect()
    truncated = len(found) > MOST_FINDINGS
    found = found[:MOST_FINDINGS]
    errors = sorted({r["text"] for r in found if r["severity"] == "ERROR"})
    warnings = sorted({r["text"] for r in found if r["severity"] == "WARN"} | {f"WARN dead_rule: {r['label']}" for r in dead_labels(program, relation).collect()})
    said = {r["qid"]: r["answer"] for r in answers(program, frames).collect()}
    return Report(not errors, errors, warnings, said, [(r["severity"], r["code"], tuple(r["values"])) for r in found], truncated)


#: Fact lines in a report's debug section, at most.
MOST_FACT_LINES = 10_000


def fact_lines(relation: DataFrame) -> DataFrame:
    """line: each fact of a relation frame as the program would state it."""
    slots = [text.render(F.col(c), "render") for c in BASE]
    return relation.select(F.concat(F.lit("relation("), F.concat_ws(", ", *slots), F.lit(")")).alias("line")).distinct()


def report_text(report: Report, policy: str, query: str = "", relation: DataFrame | None = None, traced: DataFrame | None = None) -> str:
    """The whole text of a report: what was found and answered, the facts behind the answers, and what went in.

    traced: rows of traces.trace_facts, which are bounded. Of the facts MOST_FACT_LINES are shown, in order, and the
    text says if there are more; their number is exact.
    """
    out = [report.text() + ("" if relation is None else f"\nfacts: {relation.count()}")]
    if traced is not None:
        rows = traced.orderBy(F.expr("try_cast(qid as decimal(38,0))").asc_nulls_last(), "qid", "answer", "ids", "fact_id").collect()
        lines, last = [], None
        for r in rows:
            if last != (last := (r["qid"], r["answer"], tuple(r["ids"]))):
                lines.append(f"q{r['qid']}: {r['answer']}")
            flag = " (in conflict)" if r["conflicted"] else ""
            lines.append(f"  #{r['fact_id']} {r['subject']} | {r['relation']} | {r['object']} <- {r['source'] or 'no source'}{flag}")
        out += ["--- traceability ---", *(lines or ["(none)"])]
    out += ["--- policy input ---", policy.strip()]
    if query.strip():
        out += ["--- query input ---", query.strip()]
    if relation is not None:
        shown = [r["line"] for r in fact_lines(relation).orderBy("line").limit(MOST_FACT_LINES + 1).collect()]
        more = ["(there are more facts)"] if len(shown) > MOST_FACT_LINES else []
        out += ["--- fact input ---", *(shown[:MOST_FACT_LINES] or ["(none)"]), *more]
    return "\n".join(out)


QUERY_NAME = "answer_q"


def check_query(query: str, relation: DataFrame, own: str | None = None) -> str | None:
    """Why a query draft may not run, or None: it declares only answer_q<number>(one column), states no facts,
    reads only relation, and mentions no other question's answer."""
    base = ".decl relation(subject: symbol, rel: symbol, object: symbol)\n"
    try:
        program = parse_program(base + query)
        for name, d in program.declarations.items():
            if name != "relation" and not (name.startswith(QUERY_NAME) and name.removeprefix(QUERY_NAME).isdigit() and len(d.columns) == 1):
                return f"{name} is no answer predicate"
            if own is not None and name not in ("relation", QUERY_NAME + own):
                return f"{name} belongs to another question"
        if program.facts:
            return "a query states no facts"
        if any(x.name != "relation" for r in program.rules for x in r.literals):
            return "a query reads only relation"
        evaluate(program, relation.limit(0))
    except DatalogError as e:
        return str(e)
    return None


def functional_relations(text: str) -> set[str]:
    """Labels that a policy text declares functional, by the look of its lines alone: also of a text that does
    not parse, and of lines switched off by a comment."""
    out = set()
    for piece in text.split('functional("')[1:]:
        label, quote, rest = piece.partition('"')
        if quote and rest.lstrip().startswith(")") and rest.lstrip()[1:].lstrip().startswith("."):
            out.add(label)
    return out


def review_rules(program: Program) -> int:
    """How many rules derive findings."""
    return sum(r.head.name.startswith(tuple(PREFIXES)) for r in program.rules)


CONFLICT, CONFLICT_COLUMNS = "functional_conflict", ["subject", "rel"]


def annotate(found: DataFrame, rows: DataFrame) -> DataFrame:
    """findings with note: for the conflict rule, whose columns are known, the facts behind a relation that an
    alias renamed, as (label #id=value, ...) by id; null for all else.

    rows: id, subject, relation, canonical, object of engine facts. They are matched by position and value, never
    by a finding's text. A note lists the facts of one subject and relation: it is for a person to read.
    """
    known = (F.col("code") == CONFLICT) & (F.col("columns") == F.array(*map(F.lit, CONFLICT_COLUMNS)))
    part = F.struct("id", F.concat("relation", F.lit(" #"), F.col("id").cast("string"), F.lit("="), "object").alias("part"))
    # Only the facts behind conflicts that were found are gathered.
    behind = found.filter(known).select(F.get("values", F.lit(0)).alias("subject"), F.get("values", F.lit(1)).alias("canonical")).distinct()
    notes = rows.join(behind, ["subject", "canonical"], "left_semi").groupBy("subject", "canonical").agg(F.max(F.col("relation") != F.col("canonical")).alias("renamed"), F.array_sort(F.collect_list(part)).alias("parts"))
    shown = notes.filter("renamed").select("subject", "canonical", F.concat(F.lit("("), F.array_join(F.transform("parts", lambda p: p["part"]), ", "), F.lit(")")).alias("note"))
    at = found.join(shown, known & (F.get("values", F.lit(0)) == F.col("subject")) & (F.get("values", F.lit(1)) == F.col("canonical")), "left")
    return at.drop("subject", "canonical")


def verify(rows: DataFrame, policy_text: str | None, recorded: bool, query: str = "", default: str | None = None) -> Report:
    """The check of a knowledge base: its policy's state first, then facts, rules and query, then notes and warnings.

    rows: id, subject, relation, canonical, object of engine facts. A policy that is gone or empty is the report's
    one error. A default policy that ran because none was recorded, and a policy without rules that review
    anything, are warnings: such a check says nothing of the knowledge base.
    """
    from ..sources.policy_files import PRESENT, PolicyError, policy_state, runnable_policy

    try:
        policy, warnings = runnable_policy(policy_text, recorded, default or DEFAULT_POLICY)
    except PolicyError as e:
        return Report(False, [f"ERROR policy: {e}"], [], {}, [])
    relation = base_relation(rows.select("subject", F.col("canonical").alias("relation"), "object"))
    report = run_check(relation, policy, query, rows)
    if policy_state(policy_text, recorded) == PRESENT and not report.errors and not review_rules(parse_program(policy)):
        warnings = [*warnings, "WARN policy_no_review_rules: the policy has no rule that reviews facts"]
    report.warnings = [*warnings, *report.warnings]
    return report


class InferenceCache:
    """Keeps the base relation of the last check while its fingerprint stays the same; what rules derive is new
    in every run. The relation is a saved table below a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder, self.key, self.kept = folder, None, None

    def relation(self, facts: DataFrame) -> DataFrame:
        """The relation frame of subject, relation, object strings."""
        key = tuple(fingerprint(facts.select("subject", F.col("relation").alias("rel"), "object")).first())
        if key != self.key:
            # A new folder each time: a frame handed out earlier may still read the one before.
            path = f"{self.folder}/relation-{uuid.uuid4().hex}"
            base_relation(facts).write.parquet(path)
            self.key, self.kept = key, facts.sparkSession.read.parquet(path)
        return self.kept


def fingerprint(relation: DataFrame) -> DataFrame:
    """One row, n, digest and total, that tells sets of subject, rel, object apart: equal sets have equal rows.

    A row's text tells nulls from strings and says where each slot ends; two 60-bit hashes of it are put together,
    one by exclusive or, the other by a sum.
    """
    slot = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    whole = F.md5(F.concat(slot("subject"), slot("rel"), slot("object")).cast("binary"))
    part = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    rows = relation.select("subject", "rel", "object").distinct()
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("digest"), F.coalesce(F.sum(part(17).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"))


#: A policy of our own: single-valued dates, and the class vocabulary as a comment to switch on.
DEFAULT_POLICY = """
.decl relation(subject: symbol, rel: symbol, object: symbol)
.decl functional(rel: symbol)
.decl error_functional_conflict(subject: symbol, rel: symbol)
functional("established_on").
functional("born_on").
functional("died_on").
error_functional_conflict(S, R) :- functional(R), relation(S, R, A), relation(S, R, B), A != B.
// .decl class(object: symbol, kind: symbol)
// class("company", "organisation").
// .decl warn_unknown_class(subject: symbol, object: symbol)
// warn_unknown_class(S, O) :- relation(S, "is_a", O), class(O, "unknown").
"""
