import json

import pytest
from pyspark.sql import functions as F

from tessera.datalog import DatalogError, parse_program
from tessera.functions import extraction
from tessera.operators import documents, engine, intents, lifecycle, planner
from tessera.sources import files, policy_files

BASE = ".decl relation(subject: symbol, rel: symbol, object: symbol)\n"


@pytest.mark.parametrize(
    "question, kind, entity, first",
    [
        ("김철수의 역할은 무엇인가?", "lookup_object", "김철수", "역할"),
        ("What is Ada's role?", "lookup_object", "Ada", "role"),
        ("What is Acme's founding date?", "lookup_object", "Acme", "founding date"),
        ("Show the goal of Acme Corp", "lookup_object", "Acme Corp", "목적"),
        ("How is Acme related?", "discover", "Acme", None),
        ("Which relation connects Acme to other facts?", "discover", "Acme", None),
        ("What does Acme provide?", "discover", "Acme", "provide"),
        ("아크메는 어떤 관계인가?", "discover", "아크메", None),
        ("tell me more", "unsupported", "", None),
        ("How is It related?", "unsupported", "", None),
    ],
)
def test_intents(question, kind, entity, first):
    i = planner.read_intent(question)
    assert (i.kind, i.entity, i.relations[0] if i.relations else None) == (kind, entity, first)


def test_ask(spark):
    r = spark.createDataFrame([("Acme", "purpose", "grow"), ("Acme", "role", "maker"), ("Acme", "title", "vendor"), ("Bea", "knows", "Acme")], "subject string, rel string, object string")
    got = planner.ask("What is the goal of Acme?", r, {"goal": "purpose"})
    assert (got.outcome, got.answers, got.label) == ("valid", ["grow"], "VERIFIED — engine")
    assert planner.ask("What is Acme's role?", r, {}).outcome == "ambiguous"
    assert planner.ask("How is Acme related?", r, {}).outcome == "ambiguous"
    assert planner.ask("How is Bea related?", r, {}).answers == ["knows"]
    assert planner.ask("What is Nobody's role?", r, {}).reason == "unknown_entity"
    assert planner.ask("What is Bea's role?", r, {}).reason == "no_joining_fact"
    assert planner.ask("  ", r, {}).outcome == "unsupported"


def test_alias_expansion_and_its_bound(spark):
    rel = engine.base_relation(spark.createDataFrame([("a", "founded", "1"), ("a", "established_on", "2")], "subject string, relation string, object string"))
    q = '.decl answer_q1(v: symbol)\nanswer_q1(V) :- relation("a", "founded", V).'
    assert planner.run_question(q, rel, {"founded": "established_on"}) == {"1": "1, 2"}
    many = {f"r{i}": "c" for i in range(9)}
    with pytest.raises(DatalogError):
        planner.expand_aliases(parse_program(BASE + '.decl p(a: symbol)\np(A) :- relation(A, "c", B), relation(B, "c", A).'), many)


def test_batches_decode_or_fail_whole(spark):
    good = {"subject": "a", "relation": {"kind": "term", "value": "f(1)"}, "object": "c", "confidence": "0.5"}
    texts = [json.dumps([good]), "Here: " + json.dumps({"items": [good, good]}), json.dumps({"facts": [good, {**good, "confidence": True}]}), json.dumps([{**good, "relation": {"kind": "term", "value": "X"}}]), "", None, "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(extraction.decode(F.col("x")).alias("d")).select("d.*").collect()
    assert [len(r["facts"]) for r in rows] == [1, 2, 0, 0, 0, 0, 0] and [r["error"] is None for r in rows] == [True, True, False, False, False, False, False]
    assert rows[0]["facts"][0]["relation_kind"] == "term"


def test_files_are_read_and_written_once(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"e\xcc\x81 a\0b")
    (tmp_path / "b.md").write_bytes(b"\xff")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"]["text"] == "é a�b" and got["a.txt"]["unreadable"] == 1
    assert got["b.md"]["error"].startswith("UnicodeDecodeError") and got["b.md"]["unreadable"] is None
    s = files.read_sources(spark, str(tmp_path))
    assert files.new_artifacts(s, None).count() == 1 and files.new_artifacts(s, s).count() == 0


def test_extraction_filters(spark):
    kind = {"subject_kind": "string", "relation_kind": "string", "object_kind": "string"}
    items = [
        {"subject": "date(2020)", "relation": "r", "object": "x", **kind, "subject_kind": "term"},
        {"subject": "a", "relation": "value", "object": "이다", **kind},
        {"subject": "a", "relation": "subject", "object": "f(x)", **kind, "object_kind": "term"},
        {"subject": "kim", "relation": "role", "object": "boss", **kind},
        {"subject": "org", "relation": "role", "object": "kim", **kind},
        {"subject": "漢", "relation": "role", "object": "x", **kind},
        {"subject": "a", "relation": "made_up", "object": "x", **kind},
        {"subject": "zz", "relation": "value", "object": "5명", **kind},
        {"subject": "회사", "relation": "값", "object": "5명", **kind},
    ]
    rows = [{"id": i, "batch": 1, "canonical": x["relation"], "source_text": "회사 5명. kim role boss", **x} for i, x in enumerate(items)]
    got = {r["id"]: (r["dropped"], r["relation"]) for r in documents.extraction_filters(spark.createDataFrame(rows), {"duty": "role"}).collect()}
    assert [got[i][0] for i in range(9)] == ["bad_shape", "bad_shape", "bridge", None, "reversed_role", "unbacked_han", "unbacked_ascii", "unsupported_metric", None]
    assert got[8][1] == "value"


def test_outcome_view(spark):
    rows = planner.outcome_view(spark.createDataFrame([(1, "ambiguous"), (2, "odd_state")], "id long, status string")).collect()
    assert [tuple(r) for r in rows] == [(1, "ambiguous", "Ambiguous", "rephrase"), (2, "odd_state", "Odd State", "")]


@pytest.mark.parametrize(
    "question, entity, label",
    [
        ("“김철수” 의 직책", "“김철수”", None), ("아크메에 대한 설립일은 언제인가?", "아크메", "설립일"), ("What was the founding date of Acme Corp?", "Acme Corp", "founding date"),
        ("show Ada title", "Ada", "role"), ("Find the price of it", "", None), ("아크메가 제공하는 것은?", "아크메", "제공"), ("which relation connects acme to other facts", "", None),
    ],
)
def test_more_questions(question, entity, label):
    i = intents.read_intent(question)
    assert i.entity == entity.strip("“” ") or i.entity == entity
    assert label is None or label in i.relations


def entity(v):
    return {"kind": "entity", "value": v}


def var(v):
    return {"kind": "var", "value": v}


def rel(v):
    return {"kind": "relation", "value": v}


GOOD = [
    {"kind": "lookup_object", "subject": entity(" Ada "), "relation": rel("role"), "operator": "=", "reason": "advisory"},
    {"kind": "lookup_subject", "relation": rel("role"), "object": entity("x")},
    {"kind": "lookup_relation", "subject": entity("a"), "object": entity("b")},
    {"kind": "discover_entity_relations", "subject": entity("a"), "relation_candidates": ["r"]},
    {"kind": "compare_typed_value", "relation": rel("born_on"), "operator": "<", "value_type": "date", "value": "2020-01-01"},
    {"kind": "conjunctive_lookup", "hops": [{"subject": entity("a"), "relation": rel("r"), "object": var("X")}, {"subject": var("X"), "relation": rel("s"), "object": var("Y")}]},
    {"kind": "conjunctive_filter", "conditions": [{"subject": var("X"), "relation": rel("r"), "object": entity("a")}, {"subject": var("X"), "relation": rel("s"), "object": entity("b")}]},
    {"kind": "unknown_or_unsupported", "reason": "no relation named"},
]
BAD = [
    {"kind": "other"}, {"kind": "lookup_object", "relation": rel("r")}, {"kind": "lookup_object", "subject": entity("a"), "relation": rel("r"), "value_type": "duration"}, {"kind": "unknown_or_unsupported"},
    {**GOOD[4], "object": entity("x")}, {**GOOD[4], "value": None}, {"kind": "conjunctive_lookup", "hops": GOOD[5]["hops"][:1]}, {"kind": "conjunctive_lookup", "hops": GOOD[5]["hops"][::-1]},
    {"kind": "conjunctive_filter", "conditions": [GOOD[6]["conditions"][0], {"subject": var("Z"), "relation": rel("s"), "object": entity("b")}]}, {**GOOD[3], "relation_candidates": [" "]},
]


def test_proposed_intents_are_checked():
    for g in GOOD:
        assert intents.check_intent("Sure: " + json.dumps(g) + " done")["kind"] == g["kind"]
    assert intents.check_intent(json.dumps(GOOD[0]))["subject"] == "Ada"
    for b in [json.dumps(x) for x in BAD] + ["no json"]:
        with pytest.raises(ValueError):
            intents.check_intent(b)


def test_planned_intents(spark):
    r = spark.createDataFrame([("a", "born_on", "2020-01-01"), ("b", "born_on", "2021-01-01"), ("a", "knows", "b"), ("b", "knows", "c"), ("c", "age", "ten")], "subject string, rel string, object string")
    plan = lambda i, specs=None: planner.plan_checked(intents.check_intent(json.dumps(i)), r, {"born": "born_on"}, specs)
    answers = lambda cs: sorted(x["answer"] for c in cs for x in c.answers.collect())
    compare = {**GOOD[4], "relation": rel("born"), "value": "2020-06-01"}
    assert answers(plan(compare, {"born_on": {"type": "date"}})) == ["a"] and plan(compare) == []
    with pytest.raises(DatalogError):
        plan({**compare, "relation": rel("age"), "value_type": "number"}, {"age": {"type": "number"}})
    hops = [{"subject": entity("a"), "relation": rel("knows"), "object": var("X")}, {"subject": var("X"), "relation": rel("knows"), "object": var("Y")}]
    two = plan({"kind": "conjunctive_lookup", "hops": hops})
    assert answers(two) == ["c"] and planner.atoms_of(two[0].query) == ([("a", "knows", "?V1"), ("?V1", "knows", "?V2")], "?V2")
    assert answers(plan({"kind": "lookup_relation", "subject": entity("a"), "object": entity("b")})) == ["knows"]
    assert answers(plan({"kind": "discover_entity_relations", "subject": entity("c")})) == ["age", "knows"]


def test_ask_gives_proofs_or_what_there_is_to_read(spark):
    f = spark.createDataFrame([(1, "Acme", "purpose", "grow", "goal"), (2, "Bea", "knows", "Acme", "knows")], "id long, subject string, canonical string, object string, relation string")
    docs = spark.createDataFrame([(1, "Acme wants to grow. Straße."), (2, "nothing"), (3, None)], "doc_id long, text string")
    r = f.select("subject", f["canonical"].alias("rel"), "object")
    got = planner.ask("What is the goal of Acme?", r, {"goal": "purpose"}, f, docs)
    assert got.trace == [("grow", "1")] and not got.excerpts
    lost = planner.ask("Which strasse does Acme own?", r, {}, f, docs)
    assert lost.outcome == "unsupported" and lost.excerpts[0][0] == 1 and lost.grounding == [1, 2]


def test_verify_says_what_a_check_is_worth(spark):
    rows = spark.createDataFrame([(1, "Org", "founded", "established_on", "2020"), (2, "Org", "established_on", "established_on", "2021")], "id long, subject string, relation string, canonical string, object string")
    good = engine.verify(rows, engine.DEFAULT_POLICY, True)
    assert good.errors == ["ERROR functional_conflict: Org established_on (founded #1=2020, established_on #2=2021)"] and not good.ok
    assert engine.verify(rows, None, True).errors[0].startswith("ERROR policy") and engine.verify(rows, " ", True).errors[0].startswith("ERROR policy")
    assert engine.verify(rows, None, False).warnings[0].startswith("WARN policy_unrecorded")
    bare = engine.verify(rows, ".decl relation(subject: symbol, rel: symbol, object: symbol)", True)
    assert bare.ok and bare.warnings == ["WARN policy_no_review_rules: the policy has no rule that reviews facts"]
    assert engine.functional_relations(engine.DEFAULT_POLICY) == {"established_on", "born_on", "died_on"}


def test_the_cache_follows_the_fingerprint(spark, tmp_path):
    cache = engine.InferenceCache(str(tmp_path))
    df = spark.createDataFrame([("a", "r", "x"), ("a", "r", "x")], "subject string, relation string, object string")
    first = cache.relation(df)
    assert first.count() == 1 and cache.relation(df.distinct()) is first
    assert cache.relation(df.unionByName(df.limit(1).selectExpr("subject", "relation", "'y' as object"))).count() == 2
    tell = lambda *rows: tuple(engine.fingerprint(spark.createDataFrame(rows, "subject string, rel string, object string")).first())
    sets = [[("a", None, "b")], [("a", "b", None)], [("a", "b", "")], [("ab", "", "")], [("a", "b", "-")], [("a", "", "b")], [("-", "-", "-")], [(None, None, None)], [("x", "y", "z"), ("x", "y", "w")]]
    assert len({tell(*s) for s in sets}) == len(sets) and tell(*sets[-1]) == tell(*sets[-1][::-1], *sets[-1])


def test_a_long_report_is_cut_and_says_so(spark, monkeypatch):
    facts = spark.createDataFrame([(f"s{i}", "born_on", v) for i in range(6) for v in ("1", "2")], "subject string, relation string, object string")
    monkeypatch.setattr(engine, "MOST_FINDINGS", 4)
    report = engine.run_check(engine.base_relation(facts), engine.DEFAULT_POLICY)
    assert report.truncated and len(report.errors) == 4 and report.errors[0].endswith("s0 born_on") and "more findings" in report.text()
    assert not engine.run_check(engine.base_relation(facts.limit(2)), engine.DEFAULT_POLICY).truncated


def test_of_several_results_of_a_question_the_least_counts(spark):
    q = spark.createDataFrame([(1, "pending", None, "")], "id long, status string, query_dl string, reason string")
    results = spark.createDataFrame([(1, "valid", "q2", "b"), (1, "no_answer", None, "a"), (1, "valid", "q1", "c")], "question_id long, outcome string, query string, reason string")
    assert [tuple(r) for r in lifecycle.translate(q, results).collect()] == [(1, "no_answer", None, "a")]


def test_label_variants_follow_the_aliases(spark):
    labels = spark.createDataFrame([("founded",), ("c",), ("other",), ("founded",)], "label string")
    aliases = spark.createDataFrame([("founded", "c"), ("est", "c"), ("goal", "purpose")], "raw string, canonical string")
    got = {}
    for r in policy_files.label_variants(labels, aliases).collect():
        got.setdefault(r["label"], []).append(r["variant"])
    names = {"founded": "c", "est": "c", "goal": "purpose"}
    assert {k: sorted(v) for k, v in got.items()} == {x: sorted(policy_files.variants(x, names)) for x in ("founded", "c", "other")}
