"""From a question to verified answers: intent, schema snapshot, bounded candidates, evaluation, outcome."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..datalog import DatalogError, Literal, Program, Rule, parse_program
from ..sources.policy_files import variants
from . import documents, engine, questions, traces
from .candidates import Candidate, dry_run, select_candidates
from .intents import Intent, read_intent

# Bounds.
MOST_EXPANDED, MOST_RELATIONS, MOST_FACTS = 64, 100, 50


BASE = ".decl relation(subject: symbol, rel: symbol, object: symbol)\n"


def _quoted(x: str) -> str:
    return terms.render(terms.Str(terms.nfc(x)))


def plan(intent: Intent, relation: DataFrame, aliases: dict[str, str]) -> list[Candidate]:
    """Candidate queries over the canonical relation: direct lookups first, then discovery of labels.

    The snapshot is the entity's own relations, read with one more row than its bound: past the bound the caller
    must review, so no candidate is dropped silently.
    """
    if intent.kind == "unsupported":
        return []
    own = questions.discover(relation, intent.entity).limit(2 * MOST_RELATIONS + 1).collect()
    if len(own) > 2 * MOST_RELATIONS:
        raise DatalogError("the entity has more relations than a snapshot holds")
    wanted = {v for r in intent.relations for v in variants(r, aliases)}
    out = []
    for row in sorted(own, key=lambda r: (r["side"] != "subject", r["rel"])):
        if row["rel"] in wanted or any(v in wanted for v in variants(row["rel"], aliases)):
            e, r = _quoted(intent.entity), _quoted(row["rel"])
            if row["side"] == "subject":
                out.append(Candidate("direct", f"answer_q0(V) :- relation({e}, {r}, V).", questions.lookup_object(relation, intent.entity, [row["rel"]])))
            elif intent.kind == "discover":
                out.append(Candidate("direct", f"answer_q0(V) :- relation(V, {r}, {e}).", questions.lookup_subject(relation, [row["rel"]], intent.entity)))
    if not out and intent.kind == "discover":
        e = _quoted(intent.entity)
        for row in sorted(own, key=lambda r: (r["side"] != "subject", r["rel"])):
            r, side = _quoted(row["rel"]), row["side"]
            body = f"relation({e}, {r}, O)" if side == "subject" else f"relation(S, {r}, {e})"
            found = relation.filter((F.col(side) == intent.entity) & (F.col("rel") == row["rel"])).select(F.col("rel").alias("answer")).distinct()
            out.append(Candidate(f"{side}_discovery", f"answer_q0({r}) :- {body}.", found, row["rel"]))
    return out


def _present(relation: DataFrame, labels: list[str], aliases: dict[str, str]) -> list[str]:
    """Of the labels and all that mean the same, those that facts have; a question names few."""
    wanted = sorted({v for x in labels for v in variants(x, aliases)})
    return sorted(r["rel"] for r in relation.filter(F.col("rel").isin(*wanted)).select("rel").distinct().collect())


def _exact(intent: dict, facts: DataFrame, aliases: dict[str, str]) -> list[Candidate]:
    """Lookups through the facts that name the intent's entity: their own labels, also those that an alias would
    hide. Read are the oldest, as many as a snapshot shows; with more of them nothing is proposed from them."""
    kind, out = intent["kind"], []
    entity = intent["subject"] if kind == "lookup_object" else intent["object"]
    own = questions.exact_facts(facts, entity, MOST_FACTS).collect()
    if len(own) > MOST_FACTS:
        return []
    wanted = {v for x in [intent["relation"], *intent["relations"]] for v in variants(x, aliases)}
    side = "subject" if kind == "lookup_object" else "object"
    for label in sorted({r["relation"] for r in own if r["side"] in (side, "both") and wanted & set(variants(r["relation"], aliases))}):
        e, rel = _quoted(entity), _quoted(label)
        body = f"relation({e}, {rel}, V)" if side == "subject" else f"relation(V, {rel}, {e})"
        given = facts.filter((F.col(side) == entity) & (F.col("relation") == label))
        out.append(Candidate("exact_fact", f"answer_q0(V) :- {body}.", given.select(F.col("object" if side == "subject" else "subject").alias("answer")).distinct()))
    return out


def plan_checked(intent: dict, relation: DataFrame, aliases: dict[str, str], specs: dict[str, dict] | None = None, facts: DataFrame | None = None) -> list[Candidate]:
    """Candidate queries of an intent that check_intent passed, one for each relation label that facts have.

    facts (id, subject, relation, object of the engine tier): lookups also go through the facts that name their
    entity, so that a question finds an answer where the relation list does not hold its label.

    A comparison runs only for a relation with one typed spec of the asked type, and not at all where some object
    of it has no value of that type: then no part of the answer would be sure. Equal queries are one candidate;
    more than the bound are the caller's to review.
    """
    kind, out = intent["kind"], []
    value = lambda name: intent[name]
    q = _quoted
    if kind == "lookup_object":
        for r in _present(relation, [value("relation"), *intent["relations"]], aliases):
            out.append(Candidate("direct", f"answer_q0(V) :- relation({q(value('subject'))}, {q(r)}, V).", questions.lookup_object(relation, value("subject"), [r])))
    elif kind == "lookup_subject":
        for r in _present(relation, [value("relation"), *intent["relations"]], aliases):
            out.append(Candidate("direct", f"answer_q0(V) :- relation(V, {q(r)}, {q(value('object'))}).", questions.lookup_subject(relation, [r], value("object"))))
    elif kind == "lookup_relation":
        out.append(Candidate("direct", f"answer_q0(V) :- relation({q(value('subject'))}, V, {q(value('object'))}).", questions.lookup_relation(relation, value("subject"), value("object"))))
    elif kind == "discover_entity_relations":
        out = plan(Intent("discover", value("subject"), intent["relations"]), relation, aliases)
    elif kind == "compare_typed_value":
        for r in _present(relation, [value("relation"), *intent["relations"]], aliases):
            spec = (specs or {}).get(r)
            if not spec or spec["type"] != value("value_type"):
                continue
            if not questions.incomparable(relation, r, spec["type"], spec.get("units")).isEmpty():
                raise DatalogError(f"{r} has values that are no {spec['type']}")
            found = questions.compare(relation, r, spec["type"], value("operator"), value("value"), spec.get("units"))
            out.append(Candidate("direct", f"{r} {value('operator')} {value('value')}", found.select(F.col("subject").alias("answer")).distinct()))
    elif kind in ("conjunctive_lookup", "conjunctive_three_hop_lookup"):
        hops = intent["hops"]
        for path in itertools.product(*[_present(relation, [h[1]], aliases) for h in hops]):
            ends = [q(hops[0][0][1]), *[f"V{i}" for i in range(1, len(path) + 1)]]
            body = ", ".join(f"relation({ends[i]}, {q(r)}, {ends[i + 1]})" for i, r in enumerate(path))
            out.append(Candidate("direct", f"answer_q0(V{len(path)}) :- {body}.", questions.hops(relation, hops[0][0][1], list(path))))
    elif kind == "conjunctive_filter":
        sides = []
        for s, r, o in intent["hops"]:
            labels = _present(relation, [r], aliases)
            sides.append(questions.lookup_subject(relation, labels, o[1]) if s[0] == "var" else questions.lookup_object(relation, s[1], labels))
        out.append(Candidate("direct", " and ".join(str(h) for h in intent["hops"]), questions.both(*sides)))
    if facts is not None and kind in ("lookup_object", "lookup_subject"):
        out += _exact(intent, facts, aliases)
    first: dict[str, Candidate] = {}
    for c in out:
        first.setdefault(c.query, c)
    return list(first.values())


def diagnose(intent: Intent, relation: DataFrame, aliases: dict[str, str]) -> str:
    """Why a plan is empty: the entity, or its relation, is unknown."""
    if relation.filter((F.col("subject") == intent.entity) | (F.col("object") == intent.entity)).limit(1).count() == 0:
        return "unknown_entity"
    labels = {v for r in intent.relations for v in variants(r, aliases)}
    known = relation.filter(F.col("rel").isin(*labels)).limit(1).count() if labels else 0
    return "no_joining_fact" if known else "unknown_relation"


@dataclass
class Answer:
    outcome: str
    answers: list[str] = field(default_factory=list)
    query: str = ""
    reason: str = ""
    #: Rows (answer, fact_ids) of the proofs, the best excerpts, and facts that the question names.
    trace: list[tuple] = field(default_factory=list)
    excerpts: list[tuple] = field(default_factory=list)
    grounding: list[int] = field(default_factory=list)

    @property
    def label(self) -> str:
        if self.outcome == "no_answer":
            return "VERIFIED — engine (negative)"
        return "VERIFIED — engine" if self.outcome == "valid" else "UNVERIFIED — source exploration"


def atoms_of(query: str) -> tuple[list[tuple[str, str, str]], str] | None:
    """(atoms, answer) of a query of one rule for questions.trace; None for any other program."""
    try:
        program = parse_program(BASE + ".decl answer_q0(v: symbol)\n" + query)
    except DatalogError:
        return None
    if len(program.rules) != 1 or program.rules[0].comparisons or not isinstance(program.rules[0].head.args[0], terms.Var):
        return None
    shown = lambda t: "?" + t.name if isinstance(t, terms.Var) else terms.surface(t)
    return [tuple(map(shown, x.args)) for x in program.rules[0].literals], shown(program.rules[0].head.args[0])


def ask(question: str, relation: DataFrame, aliases: dict[str, str], facts: DataFrame | None = None, docs: DataFrame | None = None, intent: dict | None = None, specs: dict[str, dict] | None = None) -> Answer:
    """The verified answer of a question, or the outcome that keeps it from one.

    intent: a model's, as check_intent passed it; without one the question's words are read. All candidates run in
    one job. facts (id, subject, canonical, object, and relation for exact lookups) of the engine tier give a
    verified answer its proofs; an answer over three facts counts as verified only where every part of it has a
    proof of three facts. What is neither verified nor known to have no answer gets the best excerpts of docs
    (doc_id, text) and the facts that the question names, for a person to read.
    """
    text = " ".join(question.split())
    read = None if intent else read_intent(text)
    if not text or (intent or {}).get("kind") == "unknown_or_unsupported" or read and read.kind == "unsupported":
        return _explored(Answer("unsupported", reason=intent["reason"] if intent and text else read.reason if read else "empty question"), text, facts, docs)
    try:
        exact = facts if facts is not None and "relation" in facts.columns else None
        proposed = plan(read, relation, aliases) if read else plan_checked(intent, relation, aliases, specs, exact)
    except DatalogError as e:
        return _explored(Answer("review_required", reason=str(e)), text, facts, docs)
    if not proposed:
        return _explored(Answer("no_answer", reason=diagnose(read, relation, aliases) if read else "no fact has the relation"), text, facts, docs)
    frame = engine.base_relation(relation.select("subject", F.col("rel").alias("relation"), "object"))
    runs = dry_run([(0, c) for c in proposed], frame, aliases)
    got = select_candidates(runs).first()
    if got["outcome"] != "valid":
        return _explored(Answer(got["outcome"], list(got["answers"]), got["query"] or ""), text, facts, docs)
    out = Answer("valid", list(got["answers"]), got["query"])
    atoms = atoms_of(out.query)
    found = traces.trace(facts, *atoms) if facts is not None and atoms else None
    out.trace = [tuple(r) for r in found.orderBy("answer", "fact_ids").collect()] if found is not None else []
    if facts is not None and atoms and len(atoms[0]) == 3:
        proved = {a for a, ids in out.trace if ids.count(",") == 2}
        if not proved.issuperset(out.answers):
            return _explored(Answer("review_required", reason="a proof of three facts is not complete"), text, facts, docs)
    return out


def _explored(out: Answer, text: str, facts: DataFrame | None, docs: DataFrame | None) -> Answer:
    if text and docs is not None:
        out.excerpts = [(r["doc_id"], r["excerpt"]) for r in documents.excerpt_search(docs, text).collect()]
    if text and facts is not None:
        out.grounding = [r["id"] for r in documents.mentioned_facts(facts, text).collect()]
    return out


def expand_aliases(program: Program, aliases: dict[str, str]) -> Program:
    """Each rule once for every combination of equal labels of its relation constants; past the bound an error."""
    rules = []
    for rule in program.rules:
        choices = []
        for x in rule.body:
            if isinstance(x, Literal) and x.name == "relation" and isinstance(x.args[1], terms.Str):
                choices.append([Literal(x.name, (x.args[0], terms.Str(v), x.args[2])) for v in variants(x.args[1].value, aliases)])
            else:
                choices.append([x])
        n = 1
        for c in choices:
            n *= len(c)
        if n > MOST_EXPANDED:
            raise DatalogError(f"a rule of {rule.head.name} expands to {n} rules, more than {MOST_EXPANDED}")
        rules += [Rule(rule.head, body) for body in itertools.product(*choices)]
    return Program(program.declarations, program.facts, rules)


def run_question(query: str, relation: DataFrame, aliases: dict[str, str]) -> dict[str, str]:
    """Answers of a query draft over the engine's relation frame, aliases expanded."""
    if why := engine.check_query(query, relation):
        raise DatalogError(why)
    program = expand_aliases(parse_program(BASE + query), aliases)
    return {r["qid"]: r["answer"] for r in engine.answers(program, engine.evaluate(program, relation)).collect()}


# Question states, with label and what to do.
OUTCOMES = {
    "pending": ("Pending", "translate"), "translated": ("Translated", "verify"), "no_answer": ("No answer", "add facts"),
    "ambiguous": ("Ambiguous", "rephrase"), "review_required": ("Review required", "review"), "translation_failed": ("Translation failed", "retry"),
}


def outcome_view(asked: DataFrame) -> DataFrame:
    """id, status, label, action of questions; unknown states show their own name."""
    book = F.create_map(*[x for k, (a, b) in OUTCOMES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("label"), F.lit(b).alias("action")))])
    view = F.try_element_at(book, F.col("status"))
    return asked.select("id", "status", F.coalesce(view["label"], F.initcap(F.replace("status", F.lit("_"), F.lit(" ")))).alias("label"), F.coalesce(view["action"], F.lit("")).alias("action"))
