"""The artifact sink under retries and reruns, and SQLite tables read in even ranges with filters applied below."""

import hashlib
import os
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import artifacts, files

ROWS = [(1, "one"), (2, "two \u0000 café"), (2, "zwei"), (3, ""), (4, None), (None, "lost"), (1, "one")]


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith((".txt", ".part")))


def test_retries_and_reruns_leave_the_same_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame(ROWS, "source_id long, text string")
    artifacts.store_artifacts(rows, folder)
    once = names(tmp_path)
    clean = "two � café"
    assert once == sorted(f"artifacts/sources/{i}/{hashlib.sha256(t.encode()).hexdigest()}.txt" for i, t in {(1, "one"), (2, clean), (2, "zwei"), (3, "")})
    artifacts.store_artifacts(rows, folder)
    assert names(tmp_path) == once
    assert sorted((r["source_id"], r["text"]) for r in artifacts.read_artifacts(spark, folder).collect()) == [(1, "one"), (2, clean), (2, "zwei"), (3, "")]


def test_a_job_that_fails_is_not_read_and_its_rerun_is(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.dataSource.register(artifacts.ArtifactSink)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], artifacts.ROWS).repartition(4)
    failing = rows.select("source_id", F.when(F.col("source_id") == 13, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="killed"):
        failing.write.format("artifacts").option("folder", folder).mode("append").save()
    assert artifacts.stored_artifacts(spark, folder) is None and artifacts.read_artifacts(spark, folder).count() == 0
    artifacts.store_artifacts(rows, folder)
    whole = names(tmp_path)
    assert len(whole) == 20 and artifacts.read_artifacts(spark, folder).count() == 20 and not [n for n in whole if n.endswith(".part")]
    at = tmp_path / whole[0]
    at.write_text("changed")
    with pytest.raises(Exception, match="broken artifact"):
        artifacts.read_artifacts(spark, folder).collect()
    at.unlink()
    with pytest.raises(Exception, match="broken artifact"):
        artifacts.read_artifacts(spark, folder).collect()


def test_texts_are_read_back_in_batches_of_bounded_size(tmp_path, monkeypatch):
    # A listing of any length is one batch; its texts are not.
    monkeypatch.setattr(artifacts, "BATCH", 10, raising=False)
    texts = ["one", "two", "a text longer than a batch", "", "four", "five", "sixes"]
    for i, t in enumerate(texts):
        (tmp_path / str(i)).write_text(t)
    listed = pa.RecordBatch.from_pydict({"source_id": list(range(7)), "path": [str(i) for i in range(7)], "checksum": [hashlib.sha256(t.encode()).hexdigest() for t in texts], "folder": [f"file://{tmp_path}"] * 7})
    got = list(artifacts._texts([listed]))
    assert [b.column("text").to_pylist() for b in got] == [["one", "two"], ["a text longer than a batch"], ["", "four", "five"], ["sixes"]]
    assert [r["source_id"] for b in got for r in b.to_pylist()] == list(range(7)) and got[0].schema.names == ["source_id", "path", "checksum", "text"]
    empty = listed.slice(0, 0)
    assert sum(len(b) for b in artifacts._texts([empty])) == 0


@pytest.fixture
def pushing(spark):
    spark.conf.set(files.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(files.PUSHDOWN)


def database(tmp_path):
    path = str(tmp_path / "kb.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE facts (id INTEGER PRIMARY KEY, subject TEXT COLLATE NOCASE, confidence REAL, note TEXT)")
        db.executemany("INSERT INTO facts VALUES (?, ?, ?, ?)", [(i if i < 90 else 10**12 + i, ["ada", "Ada", "Bea", None][i % 4], i / 100, None if i % 3 else f"n{i}") for i in range(100)])
        db.execute("CREATE TABLE empty (id INTEGER)")
    return path


def test_skewed_rowids_give_even_partitions(spark, tmp_path):
    df = files.read_sqlite(spark, database(tmp_path), "facts", pieces=7)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 15 and max(sizes) == 15 and sum(sizes) == 100


@pytest.mark.parametrize(
    "condition, pushed",
    [
        ("subject = 'ada'", True), ("subject IN ('ada', 'Bea')", True), ("subject IS NULL", True), ("note IS NOT NULL AND id > 50", True), ("confidence <= 0.25", True), ("id >= 90", True),
        ("id = 7 OR id = 8", False), ("subject > 'B'", False), ("length(note) = 2", False), ("confidence < 0.5 AND subject LIKE 'A%'", False), ("NOT (id < 95)", True), ("id = -1", True),
    ],
)
def test_filters_reach_sqlite_and_mean_the_same(pushing, tmp_path, condition, pushed):
    path = database(tmp_path)
    df = files.read_sqlite(pushing, path, "facts", pieces=3)
    got = df.filter(condition)
    plain = pushing.createDataFrame([tuple(r) for r in df.collect()], df.schema).filter(condition)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # What SQLite applies leaves Spark no filter of its own.
    plan = got._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert ("Filter" not in plan) == pushed


def test_pushed_filters_bound_what_is_read(pushing, tmp_path):
    reader = files._PushingReader(database(tmp_path), "facts", ["id"], 4, kinds={"id": "long", "subject": "string", "confidence": "double", "note": "string"})
    left = list(reader.pushFilters([files.GreaterThan(("id",), 50), files.GreaterThan(("subject",), "B"), files.EqualTo(("gone",), 1)]))
    assert [type(f) for f in left] == [files.GreaterThan, files.EqualTo]
    rows = [len(list(reader.read(p))) for p in reader.partitions()]
    assert sum(rows) == 49 and max(rows) - min(rows) <= 3
    empty = files._PushingReader(reader.path, "empty", ["id"], 4, kinds={"id": "long"})
    assert [len(list(empty.read(p))) for p in empty.partitions()] == [0]
