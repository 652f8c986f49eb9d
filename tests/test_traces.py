"""Traces against plain search over all facts, bounds included; dry runs, their outcomes, and what ask makes of them."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates, engine, intents, planner, traces
from tessera.operators.candidates import Candidate
from tessera.plans import registry

FACTS = "id long, subject string, canonical string, object string"


def brute(facts, rules, bounds):
    """(qid, answer, ids) of rules (qid, atoms, answer), all of strings with ?X for variables."""
    out = set()
    for qid, atoms, answer in rules:
        def bind(atom, fact, at):
            at = dict(at)
            for x, v in zip(atom, fact[1:], strict=True):
                if x.startswith("?"):
                    if at.setdefault(x, v) != v:
                        return None
                elif x != v:
                    return None
            return at

        names = [{x for x in a if x.startswith("?")} for a in atoms]
        counts = [sum(bind(a, f, {}) is not None for f in facts) for a in atoms]
        if max(counts) > bounds.matches or answer.startswith("?") and not any(answer in n for n in names):
            continue
        left, order, bound, ok = set(range(len(atoms))), [], set(), True
        while left and ok:
            able = [i for i in left if not order or names[i] & bound]
            if not able:
                ok = False
                break
            pick = min(able, key=lambda i: (-len(names[i] & bound) if order else 0, counts[i], i))
            order.append(pick)
            left.discard(pick)
            bound |= names[pick]
        states = {((), ())}
        for i in order if ok else []:
            new = set()
            for (at, ids), f in itertools.product(states, facts):
                if (merged := bind(atoms[i], f, dict(at))) is not None:
                    new.add((tuple(sorted(merged.items())), tuple(sorted({*ids, f[0]}))))
            states = new
            ok = ok and len(states) <= bounds.partials
        if not ok:
            continue
        proofs = {(dict(at)[answer] if answer.startswith("?") else answer, ids) for at, ids in states}
        if len(proofs) > bounds.proofs:
            continue
        if len(atoms) < 3:
            proofs = {(a, tuple(sorted({i for b, ids in proofs if b == a for i in ids}))) for a, _ in proofs}
        out |= {(qid, a, ids) for a, ids in proofs}
    return out


def test_traces_without_bounds_are_whole(spark):
    rng = random.Random(0)
    facts = [(i, rng.choice("ab"), "kr"[i % 2], rng.choice("ab")) for i in range(18)]
    endless = traces.Bounds(3, 10**6, 10**6, 10**6)
    df = spark.createDataFrame(facts, FACTS).cache()
    for atoms, answer in [
        ([("a", "k", "?X")], "?X"), ([("a", "k", "?X"), ("?X", "r", "b")], "?X"), ([("?Y", "k", "?X"), ("?X", "r", "b")], "?Y"), ([("?X", "?R", "?X"), ("?X", "r", "?Y")], "said"),
        ([("a", "?R", "?X"), ("?X", "?R", "b")], "?R"), ([("a", "k", "?X"), ("?X", "r", "b"), ("?X", "k", "a")], "?X"), ([("?X", "k", "?Y"), ("?Y", "k", "?X"), ("?X", "r", "b")], "?Y"),
    ]:
        want = sorted((a, ",".join(map(str, ids))) for _, a, ids in brute(facts, [("0", atoms, answer)], endless))
        assert sorted(tuple(r) for r in traces.trace(df, atoms, answer, None).collect()) == want and want
    assert traces.trace(df, [("nobody", "k", "?X")], "?X", None) is None


def test_the_trace_queries_leave_nothing_out(spark, monkeypatch):
    # 600 matches of an atom and 512 proofs of a rule, past the bounds of a report's trace.
    facts = [(i, "user/3", "knows", "user/4") for i in range(600)] + [(600 + i, "user/4", "established_on", "2011-02-01") for i in range(3)]
    facts += [(1000 + i, *f) for i, f in enumerate([("user/8", "knows", "user/4"), ("user/4", "role", "purchase"), ("user/4", "born_on", "2011-01-01")] * 8)]
    stored = spark.createDataFrame(facts, FACTS).withColumn("status", F.lit("accepted"))
    monkeypatch.setattr(registry, "canonical_facts", lambda *_: stored)
    assert [tuple(r) for r in registry.trace_two_atoms(spark, "").collect()] == [("user/4", ",".join(map(str, range(603))))]
    three = [tuple(r) for r in registry.trace_three_atoms(spark, "").collect()]
    assert len(three) == len(set(three)) == 512


def test_whole_traces_of_three_atoms_go_through_the_joins_in_blocks(spark, monkeypatch):
    # Several blocks a value; ids that stand for several facts, and atoms that match the same facts.
    monkeypatch.setattr(traces, "BLOCKS", (2, 1, 3))
    rng = random.Random(0)
    facts = [(rng.choice([i, i // 2]), rng.choice("ab"), "kr"[i % 2], rng.choice("ab")) for i in range(22)] * 2
    df, endless = spark.createDataFrame(facts, FACTS).cache(), traces.Bounds(3, 10**6, 10**6, 10**6)
    for atoms, answer in [
        ([("a", "k", "?X"), ("?X", "r", "b"), ("?X", "k", "a")], "?X"), ([("?X", "k", "?Y"), ("?Y", "k", "?Z"), ("?Z", "k", "a")], "?Z"),
        ([("?X", "k", "?Y"), ("?Y", "r", "?Z"), ("?X", "k", "?id")], "said"),
    ]:
        got = [tuple(r) for r in traces.trace(df, atoms, answer, None).collect()]
        assert sorted(got) == sorted((a, ",".join(map(str, ids))) for _, a, ids in brute(facts, [("0", atoms, answer)], endless)) and got


def test_whole_traces_of_three_atoms_shuffle_no_proof(spark):
    facts = [(i, f"{i // 40}", "krs"[i % 3], "x") for i in range(120)]
    got = traces.trace(spark.createDataFrame(facts, FACTS), [("?X", "k", "x"), ("?X", "r", "x"), ("?X", "s", "x")], "?X", None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and above.rindex("Generate") < above.index("Repartition")
    assert got.count() == got.distinct().count() == 3 * 13 * 13 * 14
    assert {len(r["fact_ids"].split(",")) for r in got.collect()} == {3}


def test_ids_that_are_null_have_no_text(spark):
    facts = [(None, "a", "k", "b"), (None, "b", "r", "c"), (2, "b", "r", "c"), (3, "b", "s", None), (None, "b", "s", None)]
    got = traces.trace(spark.createDataFrame(facts, FACTS), [("a", "k", "?X"), ("?X", "r", "c"), ("?X", "s", "?Y")], "?Y", None)
    assert sorted(map(tuple, got.collect())) == [(None, ""), (None, "2"), (None, "2,3"), (None, "3")]


def text_of(rules):
    slot = lambda x: x[1:] if x.startswith("?") else json.dumps(x)
    said = [f"answer_q{q}({slot(a)}) :- " + ", ".join(f"relation({', '.join(map(slot, t))})" for t in atoms) + "." for q, atoms, a in rules]
    return "\n".join([f".decl answer_q{q}(v: symbol)" for q in sorted({r[0] for r in rules})] + said)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    nodes, labels = list("abcd"), ["k", "r"]
    facts = [(i, rng.choice(nodes), rng.choice(labels), rng.choice(nodes)) for i in range(24)]
    bounds = traces.Bounds(3, 14, 40, 25)
    rules = []
    for q in range(12):
        n = rng.choice([1, 2, 3])
        atoms = [(rng.choice(["?X", "?Y", "?Z", *nodes]), rng.choice(labels + ["?R"]), rng.choice(["?X", "?Y", "?Z", *nodes])) for _ in range(n)]
        seen = sorted({x for a in atoms for x in a if x.startswith("?")})
        if not seen:
            continue
        rules.append((str(q % 5), atoms, rng.choice([*seen, "said"])))
    df = spark.createDataFrame(facts, FACTS)
    got = {(r["qid"], r["answer"], tuple(r["ids"])) for r in traces.trace_answers(df, text_of(rules), bounds).collect()}
    assert got == brute(facts, rules, bounds) and got


def test_what_is_not_traced(spark):
    df = spark.createDataFrame([(1, "a", "k", "b"), (2, "b", "k", "b")], FACTS)
    decl = ".decl answer_q1(v: symbol)\n.decl other(v: symbol)\n"
    traced = lambda rule: [(r["answer"], r["ids"]) for r in traces.trace_answers(df, decl + rule).collect()]
    assert traced('answer_q1(X) :- relation("a", "k", X).') == [("b", [1])]
    assert traced("answer_q1(X) :- relation(a, k, X).") == [("b", [1])]  # a leaf equals the string it shows as
    assert traced("answer_q1(X) :- relation(X, k, X).") == [("b", [2])]
    for rule in ("answer_q1(X) :- relation(X, k, Y), X != Y.", "answer_q1(X) :- relation(X, k, f(Y)).", "answer_q1(X) :- relation(X, k, f(b)).", "other(X) :- relation(X, k, b).",
                 "answer_q1(X) :- relation(X, k, b), relation(Z, k, Y).", "answer_q1(X) :- relation(X, k, b), relation(X, k, b), relation(X, k, b), relation(X, k, b).", "not a program"):
        assert traced(rule) == []
    assert traces.trace(df, [("a", "k", "?X"), ("?Z", "r", "x")], "?X") is None and traces.trace(df, [("?X", "k", "?Y")], "?X", traces.Bounds(matches=1)) is None


def test_a_report_orders_questions_by_number_and_flags_conflicts(spark):
    facts = spark.createDataFrame([(1, "a", "k", "k", "z", 1), (2, "a", "k", "k", "b", 2), (3, "c", "r0", "r", "d", None)], "id long, subject string, relation string, canonical string, object string, source_id long")
    sources = spark.createDataFrame([(1, "one.md"), (2, "two.md")], "id long, path string")
    evidence = spark.createDataFrame([(9, 1, 1, ""), (8, 2, 2, "said so"), (7, 2, 5, "no source")], "id long, fact_id long, source_id long, snippet string")
    disputed = spark.createDataFrame([("a", "k")], "subject string, canonical string")
    query = ".decl answer_q10(v: symbol)\n.decl answer_q2(v: symbol)\nanswer_q10(X) :- relation(S, r, X).\nanswer_q2(X) :- relation(S, k, X)."
    rows = traces.trace_facts(traces.trace_answers(facts, query), facts, sources, evidence, disputed)
    assert {r["fact_id"]: (r["relation"], r["source"], r["evidence"], r["conflicted"]) for r in rows.collect()} == {1: ("k", "one.md", "one.md", True), 2: ("k", "two.md", "said so", True), 3: ("r0", "", "", False)}
    assert [tuple(r) for r in traces.report_trace(rows).orderBy("position").collect()] == [(1, "2", "b", "2", True), (2, "2", "z", "1", True), (3, "10", "d", "3", False)]


def frame(spark, rows):
    return engine.base_relation(spark.createDataFrame(rows, "subject string, relation string, object string"))


def test_dry_runs_have_every_outcome(spark, monkeypatch):
    rel = frame(spark, [("a", "r", "x"), ("a", "s", "x"), ("a", "s", "y"), ("b", "value", "z")])
    q = lambda i, body, family="direct", label="": (i, Candidate(family, f".decl answer_q{i}(v: symbol)\nanswer_q{i}({body[0]}) :- {body[1]}.", label=label))
    broken = spark.createDataFrame([("x",)], "answer string")
    proposed = [
        q(1, ("V", 'relation("a", "r", V)')), q(1, ("V", 'relation("a", "nothing", V)')),
        q(2, ("V", 'relation("a", "r", V)')), q(2, ("V", 'relation("a", "s", V)')),
        q(3, ("V", 'relation("c", "r", V)')), (4, Candidate("direct", "no query")),
        q(5, ("V", 'relation("a", "r", V)')), q(5, ("V", ", ".join(f'relation(V, "r", V{i})' for i in range(7)))),
        q(6, ('"value"', 'relation("b", "value", V)'), "subject_discovery", "value"),
        (7, Candidate("direct", "a frame", broken)), q(7, ('"r"', 'relation("a", "r", V)'), "discovery", "r"),
    ]
    runs = candidates.dry_run(proposed, rel, {"r1": "r"})
    got = {r["question"]: (r["outcome"], r["answers"]) for r in candidates.select_candidates(runs).collect()}
    assert got == {1: ("valid", ["x"]), 2: ("ambiguous", ["x"]), 3: ("no_answer", []), 4: ("invalid", []), 5: ("engine_policy_error", []), 6: ("review_required", []), 7: ("valid", ["x"])}
    monkeypatch.setattr(candidates, "MOST_ANSWERS", 1)
    assert {r["outcome"] for r in candidates.dry_run(proposed[3:4], rel).collect()} == {"review_required"}
    monkeypatch.setattr(candidates, "MOST_CANDIDATES", 1)
    assert [r["reason"] for r in candidates.dry_run(proposed[:2], rel).collect()] == ["more candidates than a plan holds"] * 2
    assert candidates.select_candidates(candidates.dry_run([], rel)).count() == 0


def test_a_plan_that_spark_refuses_fails_its_candidate_alone(spark, monkeypatch):
    rel = frame(spark, [("a", "r", "x")])
    good = Candidate("direct", '.decl answer_q1(v: symbol)\nanswer_q1(V) :- relation("a", "r", V).')
    real = candidates._values
    monkeypatch.setattr(candidates, "_values", lambda c, *a: spark.range(1).select("gone") if c.query == "bad" else real(c, *a))
    runs = candidates.dry_run([(1, good), (2, Candidate("direct", "bad"))], rel).collect()
    assert {r["question"]: r["outcome"] for r in runs} == {1: "valid", 2: "engine_policy_error"}


def test_ask_runs_checked_intents(spark):
    f = spark.createDataFrame([(1, "a", "knows", "b", "knows"), (2, "b", "knows", "c", "knows"), (3, "c", "born_on", "1990-01-01", "born"), (4, "a", "title", "x, y", "title")], "id long, subject string, canonical string, object string, relation string")
    r = f.select("subject", f["canonical"].alias("rel"), "object")
    entity, var, rel = (lambda v, k=k: {"kind": k, "value": v} for k in ("entity", "var", "relation"))
    ask = lambda i, **more: planner.ask("as the model read it", r, {"born": "born_on"}, f, intent=intents.check_intent(json.dumps(i)), **more)
    hop = lambda s, p, o: {"subject": s, "relation": rel(p), "object": o}
    three = ask({"kind": "conjunctive_three_hop_lookup", "chain_hops": [hop(entity("a"), "knows", var("X")), hop(var("X"), "knows", var("Y")), hop(var("Y"), "born", var("Z"))]})
    assert (three.outcome, three.answers, three.trace, three.label) == ("valid", ["1990-01-01"], [("1990-01-01", "1,2,3")], "VERIFIED — engine")
    typed = ask({"kind": "compare_typed_value", "relation": rel("born"), "operator": "<", "value_type": "date", "value": "2000-01-01"}, specs={"born_on": {"type": "date"}})
    assert typed.answers == ["c"] and typed.outcome == "valid"
    assert ask({"kind": "lookup_object", "subject": entity("a"), "relation": rel("title"), "operator": "="}).answers == ["x, y"]
    none = ask({"kind": "lookup_object", "subject": entity("zed"), "relation": rel("title"), "operator": "="})
    assert none.outcome == "no_answer" and none.label == "VERIFIED — engine (negative)"
    assert ask({"kind": "unknown_or_unsupported", "reason": "small talk"}).reason == "small talk"


def test_a_proof_of_three_facts_must_be_whole(spark):
    # Two of the three atoms meet in one fact: the engine has an answer, but no proof of three facts.
    f = spark.createDataFrame([(1, "a", "k", "a")], FACTS)
    r = f.select("subject", f["canonical"].alias("rel"), "object")
    hops = [{"subject": {"kind": k, "value": v}, "relation": {"kind": "relation", "value": "k"}, "object": {"kind": "var", "value": o}} for k, v, o in (("entity", "a", "X"), ("var", "X", "Y"), ("var", "Y", "Z"))]
    got = planner.ask("three", r, {}, f, intent=intents.check_intent(json.dumps({"kind": "conjunctive_three_hop_lookup", "chain_hops": hops})))
    assert got.outcome == "review_required" and got.label.startswith("UNVERIFIED")


def test_exact_facts_answer_where_the_relation_list_hides_a_label(spark):
    f = spark.createDataFrame([(1, "a", "founded", "1990"), (2, "b", "founded", "1991"), (3, "c", "likes", "a")], "id long, subject string, relation string, object string")
    r = spark.createDataFrame([("b", "established_on", "1991")], "subject string, rel string, object string")
    entity = lambda v: {"kind": "entity", "value": v}
    intent = intents.check_intent(json.dumps({"kind": "lookup_object", "subject": entity("a"), "relation": {"kind": "relation", "value": "founded"}, "operator": "="}))
    found = planner.plan_checked(intent, r, {"founded": "established_on"}, facts=f)
    assert [(c.family, sorted(x["answer"] for x in c.answers.collect())) for c in found] == [("direct", []), ("exact_fact", ["1990"])]


def test_a_report_shows_what_went_in_and_what_is_behind(spark, monkeypatch):
    facts = spark.createDataFrame([(1, "a", "born_on", "born_on", "1990", 1), (2, "a", "born", "born_on", 'the "1991"', None)], "id long, subject string, relation string, canonical string, object string, source_id long")
    relation = engine.base_relation(facts.select("subject", facts["canonical"].alias("relation"), "object"))
    query = '.decl answer_q1(v: symbol)\nanswer_q1(V) :- relation("a", "born_on", V).'
    none = spark.createDataFrame([], "id long, fact_id long, source_id long, snippet string")
    traced = traces.trace_facts(traces.trace_answers(facts, query), facts, spark.createDataFrame([(1, "one.md")], "id long, path string"), none, facts.select("subject", "canonical"))
    report = engine.run_check(relation, engine.DEFAULT_POLICY, query)
    text = engine.report_text(report, engine.DEFAULT_POLICY, query, relation, traced)
    assert text.startswith("inconsistent: 1 errors") and "\nfacts: 2\n" in text and "ANSWER q1: 1990, the " in text
    assert "q1: 1990\n  #1 a | born_on | 1990 <- one.md (in conflict)\n" in text and "  #2 a | born | the " in text and "<- no source" in text
    assert text.index("--- traceability ---") < text.index("--- policy input ---") < text.index("--- query input ---") < text.index("--- fact input ---")
    assert text.endswith('relation("a", "born_on", "1990")\nrelation("a", "born_on", "the \\"1991\\"")')
    monkeypatch.setattr(engine, "MOST_FACT_LINES", 1)
    assert engine.report_text(report, "p", "", relation).endswith("(there are more facts)") and "--- query input" not in engine.report_text(report, "p")
