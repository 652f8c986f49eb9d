import pytest

from tessera.datalog import DatalogError, parse_program, stratify, validate
from tessera.operators import engine

BASE = ".decl relation(subject: symbol, rel: symbol, object: symbol)\n"


def frame(spark, rows, plain=False):
    return engine.base_relation(spark.createDataFrame(rows, "subject string, relation string, object string"), plain)


def derive(spark, rows, body, name):
    frames = engine.evaluate(parse_program(BASE + body), frame(spark, rows))
    return sorted(tuple(c for i, c in enumerate(r) if i % 2) for r in frames[name].collect())


def test_conflict_is_one_error_and_dead_labels_warn(spark):
    r = engine.run_check(frame(spark, [("Org", "established_on", "2020"), ("Org", "established_on", "2021"), ("Org", "is_a", "company")]), engine.DEFAULT_POLICY)
    assert not r.ok and r.errors == ["ERROR functional_conflict: Org established_on"]
    assert r.warnings == ["WARN dead_rule: born_on", "WARN dead_rule: died_on"]


def test_joins_repeated_variables_and_inequality(spark):
    rows = [("Ada", "parent", "Bea"), ("Bea", "parent", "Cal"), ("Bea", "parent", "Cal"), ("Ada", "same_as", "Ada"), ("Ada", "related_to", "Bea"), ("Cal", "related_to", "Cal")]
    assert derive(spark, rows, '.decl g(a: symbol, b: symbol)\ng(A, C) :- relation(A, "parent", B), relation(B, "parent", C).', "g") == [("s:Ada", "s:Cal")]
    assert derive(spark, rows, '.decl s(a: symbol)\ns(A) :- relation(A, "same_as", A).', "s") == [("s:Ada",)]
    assert derive(spark, rows, '.decl d(a: symbol)\nd(A) :- relation(A, "related_to", B), A != B.', "d") == [("s:Ada",)]
    assert derive(spark, rows, '.decl e(a: symbol)\ne(A) :- relation(A, "related_to", B), A == B.', "e") == [("s:Cal",)]


def test_atoms_and_strings_are_one_value(spark):
    assert derive(spark, [("ada", "born_on", "1815")], ".decl v(x: symbol)\nv(X) :- relation(ada, born_on, X), X == 1815.", "v") == [("s:1815",)]


def test_zero_arity_and_facts_only(spark):
    frames = engine.evaluate(parse_program(BASE + '.decl any()\nany() :- relation(X, "r", Y).\n.decl k(a: symbol)\nk("x").\nk("y").\n.decl n()\nn() :- 1 == 2.'), frame(spark, [("a", "r", "b")]))
    assert frames["any"].count() == 1 and frames["k"].count() == 2 and frames["n"].count() == 0


def test_strata_and_union(spark):
    body = ".decl a(x: symbol)\n.decl b(x: symbol)\nb(X) :- a(X).\na(X) :- relation(X, R, Y).\na(Y) :- relation(X, R, Y)."
    assert derive(spark, [("p", "r", "q")], body, "b") == [("s:p",), ("s:q",)]
    assert stratify(parse_program(BASE + body)) == ["a", "b"]


@pytest.mark.parametrize(
    "body, said",
    [
        (".decl a(x: symbol)\n.decl b(x: symbol)\na(X) :- b(X).\nb(X) :- a(X).", "recursive rules are not supported: a -> b -> a"),
        (".decl a(x: number)", "not supported"),
        (".decl a(x: symbol)\n.decl a(x: symbol)", "twice"),
        ("a(X) :- relation(X, R, Y).", "not declared"),
        (".decl a(x: symbol)\na(X, Y) :- relation(X, R, Y).", "columns"),
        (".decl a(x: symbol)\na(Z) :- relation(X, R, Y).", "unsafe"),
        (".decl a(x: symbol)\na(X) :- relation(X, R, Y), not a(X).", "negation"),
        (".decl a(x: symbol)\na(X) :- relation(X, R, Y), X < Y.", "not supported"),
        (".decl a(x: symbol)\na(X).", "variables"),
        (".decl a(__cmp_x: symbol)", "reserved"),
        ('relation("a", "b", "c").', "states no facts"),
    ],
)
def test_refusals(spark, body, said):
    r = engine.run_check(frame(spark, [("a", "r", "b")]), BASE + body)
    assert not r.ok and said in r.errors[0]


def test_comments_outside_strings_only(spark):
    assert derive(spark, [("http://x", "r", "b")], '// one\n.decl a(x: symbol)\na(X) :- relation(X, "r", Y), X == "http://x". // two', "a") == [("s:http://x",)]


def test_answers_are_bucketed_in_numeric_order(spark):
    q = '.decl answer_q10(v: symbol)\n.decl answer_q2(v: symbol)\nanswer_q10(V) :- relation(S, "r", V).\nanswer_q2(S) :- relation(S, "r", V).'
    r = engine.run_check(frame(spark, [("a", "r", "x, y"), ("b", "r", "z")]), BASE, q)
    assert list(r.answers.items()) == [("2", "a, b"), ("10", "x\\, y, z")]


def test_query_gate(spark):
    rel = frame(spark, [("a", "r", "b")])
    ok = '.decl answer_q1(v: symbol)\nanswer_q1(V) :- relation("a", "r", V).'
    assert engine.check_query(ok, rel) is None and engine.check_query(ok, rel, "1") is None
    assert engine.check_query(ok, rel, "2") and engine.check_query(".decl other(v: symbol)", rel)
    assert engine.check_query('.decl answer_q1(v: symbol)\nanswer_q1("x").', rel)


def test_empty_relation(spark):
    r = engine.run_check(frame(spark, []), engine.DEFAULT_POLICY)
    assert r.ok and r.warnings == []
    validate(parse_program(engine.DEFAULT_POLICY))
    with pytest.raises(DatalogError):
        engine.evaluate(parse_program(".decl relation(a: symbol)"), frame(spark, []))
