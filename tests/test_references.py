"""Deletes and merges along references, and stored terms that fail closed, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import references, store

SCHEMAS = {
    "sources": "id long, kind string", "artifacts": "id long, source_id long", "jobs": "id long, source_id long, artifact_id long", "chunks": "id long, source_id long, job_id long",
    "facts": "id long, source_id long, job_id long", "terms": "fact_id long", "evidence": "id long, fact_id long, source_id long, artifact_id long, chunk_id long", "events": "id long, fact_id long, source_id long",
}


def columns(name):
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def brute(tables, gone):
    tables = {n: [dict(zip(columns(n), r, strict=True)) for r in rows] for n, rows in tables.items()}
    dead = {n: set(ids) & {r.get("id") for r in tables[n]} for n, ids in gone.items()}
    while True:
        before = {n: set(x) for n, x in dead.items()}
        for t, c, parent, how in references.REFERENCES:
            if how == references.CASCADE and t in tables:
                dead.setdefault(t, set()).update(r["id"] for r in tables[t] if "id" in r and r.get(c) is not None and r.get(c) in dead.get(parent, ()))
        if dead == before:
            break
    out = {}
    for name, rows in tables.items():
        refs = [x for x in references.REFERENCES if x[0] == name and x[1] in columns(name)]
        kept = [r for r in rows if r.get("id") not in dead.get(name, ()) and not any(how == references.CASCADE and r[c] is not None and r[c] in dead.get(p, ()) for _, c, p, how in refs)]
        for r in kept:
            for _, c, p, how in refs:
                if how == references.UNSET and r[c] in dead.get(p, ()):
                    r[c] = None
        out[name] = sorted(map(str, [tuple(r.values()) for r in kept]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_delete_equals_a_loop_and_leaves_no_new_orphans(spark, seed):
    rng = random.Random(seed)
    tables = {}
    for name in SCHEMAS:
        value = lambda c: rng.choice([None, *range(12)]) if c != "kind" else "text"
        tables[name] = [(i, *[value(c) for c in columns(name)[1:]]) if columns(name)[0] == "id" else (value("x"),) for i in range(10 if name == "sources" else 30)]
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}
    gone = {"sources": [1, 4, 99], "facts": [3]}
    left = references.delete(frames, {n: spark.createDataFrame([(i,) for i in ids], "id long") for n, ids in gone.items()})
    assert {n: sorted(str(tuple(r)) for r in df.collect()) for n, df in left.items()} == brute(tables, gone)
    before = {tuple(r) for r in references.dangling(frames).collect()}
    assert {tuple(r) for r in references.dangling(left).collect()} <= before


FACTS = "id long, subject string, relation string, object string, status string"
TERMS = "fact_id long, subject string, rel string, object string, term_token string"


def test_the_engine_scan_fails_on_one_broken_row(spark):
    facts = spark.createDataFrame([(i, f"s{i}", "r", "o", "confirmed" if i < 8 else "candidate") for i in range(10)], FACTS)
    good = store.repaired_terms(facts, spark.createDataFrame([], TERMS))
    assert store.check_terms(facts, good).count() == 0
    assert sorted(r["id"] for r in store.engine_terms(facts, good).collect()) == list(range(8))
    lost, wrong = good.filter("fact_id <> 3"), good.withColumn("object", F.when(F.col("fact_id") == 5, "x").otherwise(F.col("object")))
    for broken, said in ((lost, "fact 3 are missing"), (wrong, "fact 5 differ"), (good.withColumn("term_token", F.lit(None).cast("string")), "differ")):
        for action in (lambda df: df.collect(), lambda df: df.select("id").count(), lambda df: df.filter("subject = 'nobody'").collect(), lambda df: df.select(F.lit(1)).collect()):
            with pytest.raises(Exception, match=said):
                action(store.engine_terms(facts, broken))
        assert store.engine_terms(facts, store.repaired_terms(facts, broken)).count() == 8
        assert store.whole_terms(facts, broken).count() < 8


def test_review_terms_are_not_asked_for(spark):
    facts = spark.createDataFrame([(1, "s", "r", "o", "candidate")], FACTS)
    assert store.engine_terms(facts, spark.createDataFrame([], TERMS)).count() == 0


NFD, NFC = "sources/René.txt", "sources/René.txt"


@pytest.mark.parametrize(
    "rows, jobs, files, status, kept",
    [
        ([(5, NFD, "text"), (9, NFC, "text")], [], [(NFD, "x"), (NFC, "x")], "ready", 9),
        ([(5, NFD, "text"), (9, NFD, "text")], [], [(NFD, "x")], "ready", 5),
        ([(5, NFD, "text"), (9, NFC, "binary")], [(1, 5, "running")], [(NFD, "x"), (NFC, "x")], "mixed_source_kind", 9),
        ([(5, NFD, "text"), (9, NFC, "text")], [(1, 5, "pending"), (2, 9, "done")], [(NFD, "x"), (NFC, "x")], "active_extraction_job", 9),
        ([(5, NFD, "text"), (9, NFC, "text")], [(1, 5, "failed")], [(NFD, "x"), (NFC, "y")], "distinct_paths", 9),
        ([(5, NFD, "text"), (9, NFC, "text")], [], [(NFD, "x")], "unprovable_path", 9),
        ([(5, NFC, "text"), (9, "other", "text")], [], [], None, None),
        ([(5, NFC, "text"), (9, NFC, "text")], [], [(NFC, "x")], None, None),
    ],
)
def test_identities_merge_only_where_it_is_proved(spark, rows, jobs, files, status, kept):
    sources = spark.createDataFrame(rows, "id long, path string, kind string")
    groups = references.identity_groups(sources, spark.createDataFrame(jobs, "id long, source_id long, status string"), spark.createDataFrame(files, "path string, checksum string"))
    got = {(r["id"], r["kept_id"], r["status"], r["canonical_path"]) for r in groups.collect()}
    assert got == ({(i, kept, status, NFC) for i, *_ in rows} if status else set())
    facts = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id long, source_id long")
    artifacts = spark.createDataFrame([(1, 5, "a", "c"), (2, 9, "a", "c"), (3, 5, "b", "c"), (4, 5, "a", "c")], "id long, source_id long, kind string, checksum string")
    evidence = spark.createDataFrame([(1, 5, 1), (2, 5, 3), (3, 9, 4)], "id long, source_id long, artifact_id long")
    after = references.merge_sources({"sources": sources, "facts": facts, "artifacts": artifacts, "evidence": evidence}, groups)
    if status != "ready":
        assert all(sorted(map(tuple, after[n].collect()), key=str) == sorted(map(tuple, t.collect()), key=str) for n, t in (("sources", sources), ("facts", facts), ("artifacts", artifacts), ("evidence", evidence)))
        return
    other = 14 - kept
    assert [tuple(r) for r in after["sources"].collect()] == [(kept, NFC, "text")]
    assert sorted((r["id"], r["source_id"]) for r in after["facts"].collect()) == [(1, kept), (2, kept), (3, None)]
    # Of the merged source's artifacts those that the kept one has go; its own twins stay.
    stay = {9: [2, 3], 5: [1, 3, 4]}[kept]
    assert sorted(r["id"] for r in after["artifacts"].collect()) == stay and {r["source_id"] for r in after["artifacts"].collect()} == {kept}
    assert sorted((r["id"], r["source_id"], r["artifact_id"]) for r in after["evidence"].collect()) == {9: [(1, 9, 2), (2, 9, 3), (3, 9, 2)], 5: [(1, 5, 1), (2, 5, 3), (3, 5, 4)]}[kept]
    assert [tuple(r) for r in references.merge_log(groups).collect()] == [(NFC, kept, [other])]
    again = references.identity_groups(after["sources"], spark.createDataFrame([], "id long, source_id long, status string"), spark.createDataFrame(files, "path string, checksum string"))
    assert again.count() == 0


def test_tokens_tell_apart_what_looks_alike(spark):
    facts = spark.createDataFrame(
        [(1, 7, "a", "age", "36", "confirmed", "str"), (2, 7, "a", "age", "40", "superseded", None), (3, 7, "a", "age", "50", "superseded", "t50"), (4, 7, "a", "age", "50", "candidate", None), (5, None, "a", "r", "x", "confirmed", "tx")],
        "id long, source_id long, subject string, relation string, object string, status string, term_token string",
    )
    incoming = [(7, "num", "a", "age", "36"), (7, "str", "a", "age", "36"), (7, "n40", "a", "age", "40"), (7, "t50", "a", "age", "50"), (8, "str", "a", "age", "36"), (None, "tx", "a", "r", "x"), (7, "str", "a", "age", "36")]
    got = store.reconcile_terms(spark.createDataFrame(incoming, "source_id long, term_token string, subject string, relation string, object string"), facts)
    assert {(r["source_id"], r["term_token"]): (r["action"], r["fact_id"]) for r in got.collect()} == {
        (7, "num"): ("insert", None), (7, "str"): ("keep", 1), (7, "n40"): ("suppress", 2), (7, "t50"): ("keep", 4), (8, "str"): ("insert", None), (None, "tx"): ("keep", 5),
    }
    assert got.count() == 6
