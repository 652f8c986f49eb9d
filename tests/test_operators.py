import datetime

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text, typed
from tessera.operators import analytics, documents, questions, store, trust
from tessera.sources import policy_files as pf


@pytest.mark.parametrize(
    "kind, raw, want",
    [
        ("date", "2024.7.3", 20240703), ("date", "date(2024, 7)", 20240701), ("date", "2024-02-30", None), ("date", "２０２４-07-03", 20240703), ("date", "x", None),
        ("number", "1,234.567", 1234567), ("number", "number(1.0005)", 1001), ("number", "-2.0005", -2001), ("number", "1.2.3", None),
        ("ordinal", "제3호", 3), ("ordinal", "4th", 4), ("ordinal", "ordinal(9)", 9), ("ordinal", "th", None),
        ("amount", 'amount(5400,"억")', 540000000000), ("amount", 'amount(0.54,"조")', 540000000000), ("amount", "3만원", 30000), ("amount", "3 furlong", None), ("amount", "9999999999999조", None),
    ],
)
def test_typed_values(spark, kind, raw, want):
    df = spark.createDataFrame([(raw,), (None,)], "x string")
    assert [r[0] for r in df.select(typed.typed_key(kind, F.col("x"))).collect()] == [want, None]


def test_exact_parser_is_stricter(spark):
    df = spark.createDataFrame([("2024.7.3", "1,2345", "1억원"), ("2024-07-03", "12,345", "1억")], "d string, n string, a string")
    rows = df.select(typed.exact_key("date", F.col("d")), typed.exact_key("number", F.col("n")), typed.exact_key("amount", F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(None, None, None), (20240703, 12345000, 100000000)]


def test_unicode_text(spark):
    df = spark.createDataFrame([("é",), ("Straße",), (None,)], "x string")
    assert [r[0] for r in df.select(text.nfc(F.col("x"))).collect()] == ["é", "Straße", None]
    assert [r[0] for r in df.select(text.fold(F.col("x"))).collect()] == ["é", "strasse", None]
    s = spark.createDataFrame([("a\u0000b\u0000",)], "x string").select(text.sanitize(F.col("x")).alias("s")).select("s.*").first()
    assert tuple(s) == ("a�b�", 2)
    assert spark.range(1).select(text.split_roles(F.lit("김철수대표"))).first()[0] == "김철수 대표 (원문: 김철수대표)"


def test_alias_files():
    a = pf.parse_aliases("# x\n- `founded` -> `established_on`\n* goal -> purpose\n")
    assert a == {"founded": "established_on", "goal": "purpose"}
    assert pf.canonical("founded", a) == "established_on" and pf.canonical("other", a) == "other"
    assert pf.variants("founded", a) == ["founded", "established_on"]
    for bad in ["a b", "a -> a", "a -> b\na -> c", "a -> b\nb -> c", "`a -> b", " -> b"]:
        with pytest.raises(pf.PolicyError):
            pf.parse_aliases(bad)
    merged = pf.with_defaults({"established_on": "started"})
    assert "founded" not in merged and merged["goal"] == "purpose"


def test_typed_relation_files():
    got = pf.parse_typed_relations("- `매출` : amount as revenue (억원=100000000)\nskip me\n- a : colour as b\n- born : date as birth")
    assert got["매출"] == {"type": "amount", "alias": "revenue", "units": {"억원": 100000000}} and got["born"]["type"] == "date" and len(got) == 2
    for bad in ["a : date as x (u=1)", "a : amount as x (u=0)", "a : date as x\nb : date as x"]:
        with pytest.raises(pf.PolicyError):
            pf.parse_typed_relations(bad)


def test_dl_round_trip(spark):
    rows = [("a\nb", 'q"q', "c"), ("a\nb", 'q"q', "c"), ("x", "y", "\\")]
    out = "\n".join(r["line"] for r in pf.export_dl(spark.createDataFrame(rows, "subject string, relation string, object string")).collect())
    assert sorted(pf.import_dl(".decl relation(subject: symbol, rel: symbol, object: symbol)\n" + out)) == sorted(set(rows))


def facts(spark, rows):
    return spark.createDataFrame([(i, s, r, o, st, src, None, False) for i, (s, r, o, st, src) in enumerate(rows, 1)], "id long, subject string, relation string, object string, status string, source_id long, job_id long, stale boolean")


def test_corroboration_counts_distinct_sources_of_the_engine_tier(spark):
    f = facts(spark, [("Acme", "uses", "X", "confirmed", 1), ("Acme", "uses", "X", "accepted", 2), ("Acme", "uses", "X", "confirmed", 2), ("Acme", "uses", "X", "candidate", 3), ("Acme", "uses", "X", "confirmed", None)])
    got = trust.corroboration(trust.with_keys(f, pf.alias_frame(spark, {}))).collect()
    assert [(r["n_sources"], r["sources"]) for r in got] == [(2, "1, 2")]


def test_typed_twins_are_no_conflict(spark):
    f = facts(spark, [("a", "born_on", "2024-07-03", "confirmed", 1), ("a", "born_on", "2024.7.3", "accepted", 2), ("b", "born_on", "2024", "confirmed", 1), ("b", "born_on", "2025", "confirmed", 2)])
    k = trust.with_keys(f, pf.alias_frame(spark, {}), {"born_on": {"type": "date"}})
    functional = spark.createDataFrame([("born_on",)], "rel string")
    assert sorted((r["subject"], r["object"]) for r in trust.single_valued_conflicts(k, functional).collect()) == [("b", "2024"), ("b", "2025")]


def test_acceptance_reasons(spark):
    rows = [
        ("a", "r", "x", "candidate", 1), ("a", "r", "x", "candidate", 2), ("b", "r", "x", "candidate", 1), ("c", "r", "x", "candidate", None), ("d", "r", "x", "accepted", 5),
        ("e", "r", "x", "candidate", 1), ("e", "r", "x", "confirmed", 2), ("e", "r", "x", "superseded", 1), ("f", "s", "x", "candidate", 1), ("f", "s", "x", "candidate", 2), ("f", "s", "y", "candidate", 3),
        ("g", "r", "x", "candidate", 1), ("g", "r", "x", "candidate", 2),
    ]
    f = facts(spark, rows).withColumn("job_id", F.when(F.col("subject") == "g", None).otherwise(1).cast("long"))
    jobs = spark.createDataFrame([(1, "done")], "id long, status string")
    events = spark.createDataFrame([], "fact_id long, event_type string")
    functional = spark.createDataFrame([("s",)], "rel string")
    got = {r["id"]: (r["support"], r["reasons"]) for r in trust.acceptance(trust.with_keys(f, pf.alias_frame(spark, {})), jobs, events, functional).collect()}
    assert got[1] == got[2] == (2, "") and got[3] == (1, "insufficient_distinct_source_support")
    assert got[4] == (0, "source_missing, insufficient_distinct_source_support") and got[5][1].startswith("not_review_candidate")
    assert got[6] == (1, "previously_rejected_or_superseded, insufficient_distinct_source_support") and got[8][0] == 1
    assert got[9] == (2, "single_valued_conflict") and got[12] == (2, "source_analysis_incomplete")


def test_decisions_fold_in_order(spark):
    from tessera.operators import lifecycle

    f = facts(spark, [("a", "r", "x", "candidate", 1), ("b", "r", "x", "confirmed", 1), ("c", "r", "x", "superseded", 1), ("d", "r", "x", "candidate", 1)])
    made = [(1, 1, "accept", "candidate"), (2, 1, "accept", "candidate"), (3, 1, "toggle", None), (4, 2, "reject", None), (5, 2, "toggle", None), (6, 3, "accept", None), (7, 4, "amend", None), (8, 3, "amend", None)]
    d = spark.createDataFrame([(*m, None, None, "y" if m[2] == "amend" else None) for m in made], "id long, fact_id long, action string, observed string, subject string, relation string, object string")
    out = lifecycle.review(f, d)
    assert sorted((r["id"], r["status"], r["object"]) for r in out.collect()) == [(1, "needs_review", "x"), (2, "superseded", "x"), (3, "superseded", "x"), (4, "candidate", "y")]
    assert sorted(tuple(r) for r in lifecycle.review_log(out).collect()) == [(1, 1, "accept", "candidate", "confirmed"), (1, 3, "toggle", "confirmed", "needs_review"), (2, 4, "reject", "confirmed", "superseded"), (4, 7, "amend", "d | r | x", "d | r | y")]


def test_empty_tier_raises():
    with pytest.raises(ValueError):
        schema.in_tier(())


@pytest.mark.parametrize("page, total, size, want", [(0, 10, 25, 1), (9, 60, 25, 3), (2, 0, 50, 1)])
def test_page_clamp(page, total, size, want):
    assert analytics.clamp_page(page, total, size) == want


def test_chunks():
    assert documents.chunks_of("  \n ") == [] and documents.chunks_of("one") == ["one"]
    got = documents.chunks_of("a" * 200 + "\n\n" + "b" * 200 + "\n \n" + "c" * 650)
    assert [len(c) for c in got] == [200, 242, 342, 342, 92] and got[1].startswith("a" * 40 + "\n\n")
    with pytest.raises(ValueError):
        documents.chunks_of("x", 0)


def test_streamed_latest_events(spark, tmp_path):
    from tessera.streaming.events import latest_events, read_events

    spark.createDataFrame([(1, 7, "created"), (2, 7, "rejected"), (3, 8, "created")], "id long, fact_id long, event_type string").select("id", "fact_id", "event_type", F.lit("human").alias("actor"), F.lit(1).cast("long").alias("source_id"), F.lit("").alias("rule_name"), F.lit(None).cast("string").alias("before_json"), F.lit(None).cast("string").alias("after_json"), F.current_timestamp().alias("at")).write.parquet(str(tmp_path / "e"))
    q = latest_events(read_events(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["fact_id"], r["event_type"]) for r in spark.table("latest").collect()) == [(7, "rejected"), (8, "created")]


def test_date_keys_are_of_the_calendar_and_parsed_once(spark):
    texts = [f"{y:04d}-{m:02d}-{d:02d}" for y in (0, 1, 1582, 1900, 2000, 2023, 2024, 9999) for m in range(14) for d in (0, 1, 10, 28, 29, 30, 31, 32)]
    texts += ["2024.7.3", "2024/7", "date(2024, 2)", "DATE(2023,2,29)", "date(2024,2,29)", "٢٠٢٤-٠٧-٠٣", "2024-07-03 ", "role", "", None]

    def plain(t):
        try:
            return int(datetime.date.fromisoformat(t).strftime("%Y%m%d"))
        except ValueError:
            return None

    want = [plain(t) for t in texts[:-10]] + [20240703, 20240701, 20240201, None, 20240229, 20240703, None, None, None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", typed.date_key(F.col("t")).alias("k"))
    assert [r["k"] for r in df.orderBy("i").collect()] == want
    # Three parts of two forms, each named once in the plan: a repeated part is parsed again for every fact.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 6
