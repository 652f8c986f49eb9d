"""The pipeline against the same decisions taken by brute force on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, mixing, secrets
from test_llm_operators import brute_components, brute_overlaps

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scans", "mixing"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(90).collect()
    table = spark.createDataFrame(docs)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [table]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
        assert steps[-1].columns[: len(table.columns)] == table.columns
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in steps]
    text = {r["doc_id"]: r["text"] for r in docs}

    model = langid.train(table.filter(~langid.held_out(F.col("doc_id"))))
    und = {r["doc_id"] for r in langid.identify(table, model).collect() if r["lang_pred"] == "und" or (r["languages"] and r["gain"] < 0)}
    assert ids[1] == [i for i in ids[0] if i not in und]

    groups = brute_components(ids[1], [text[i] for i in ids[1]], jaccard.Rule(5, 80, 100))
    assert ids[2] == sorted({c for _, c in groups.values()})

    hit = {ids[2][d] for d, _ in brute_overlaps([text[i] for i in ids[2]], [t for _, t in bench])}
    assert ids[3] == [i for i in ids[2] if i not in hit]

    assert ids[4] == ids[3]
    for r in steps[4].collect():
        spans = secrets.secret_report(table.filter(F.col("doc_id") == r["doc_id"])).first()["spans"] if r["text"] != text[r["doc_id"]] else ""
        assert (r["text"] == text[r["doc_id"]]) == (spans == "")

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(steps[4]).collect()}
    taken = {}
    for r in steps[5].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert taken == {i: n for i, n in copies.items() if n}


def test_the_last_two_stages_by_their_rules_alone(spark):
    """No secret of the base kinds is left, nothing else of a text is changed, and each source's words come near what
    the weights give it: from the rules, without the operators' own reports."""
    import re

    from test_llm_operators import SPACES, brute_targets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.redact_secrets(spark, docs, SF).cache()
    base = [re.compile("(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)[A-Za-z0-9+/_.=-]{12,}"), re.compile("AKIA[A-Z0-9]{14,}"), re.compile("(?<![0-9a-f])[0-9a-f]{16,}(?![0-9a-f])")]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    touched = 0
    for r in clean.collect():
        text, old = r["text"], before[r["doc_id"]]
        if old is None:
            assert text is None
            continue
        had = any(p.search(old) for p in base)
        touched += had
        assert had <= (text != old) and not any(p.search(text) for p in base)
        # What is left between the marks stands in the old text, in this order.
        at = 0
        for piece in re.split(r"\[SECRET:[a-z]+\]", text) if text != old else []:
            at = old.find(piece, at)
            assert at >= 0
            at += len(piece)
    assert touched > 0
    sizes, taken, largest = {}, {}, {}
    for r in clean.collect():
        n = len(SPACES.findall(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    for r in corpus_pipeline.mix_sources(spark, clean, SF).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(SPACES.findall(r["text"] or ""))
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(0.02 * target, largest[source]), source


def test_run_over_a_whole_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and "copy_no" in out.columns
    assert decontam.find_overlaps(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
