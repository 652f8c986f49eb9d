import pytest

from tessera.functions import units
from tessera.sources import policy_files as pf


@pytest.mark.parametrize("text, recorded, want", [("x", False, "present"), (" \n", True, "present_empty"), ("﻿", False, "present_empty"), (None, True, "missing_recorded"), (None, False, "unrecorded_default")])
def test_policy_states(text, recorded, want):
    assert pf.policy_state(text, recorded) == want
    if want in (pf.PRESENT, pf.UNRECORDED_DEFAULT):
        policy, warnings = pf.runnable_policy(text, recorded, "d")
        assert policy == (text or "d") and bool(warnings) == (text is None)
    else:
        with pytest.raises(pf.PolicyError):
            pf.runnable_policy(text, recorded, "d")


MEASURED = [
    ("공사는 몇 년인가?", "24개월", ("년", "개월")), ("공사는 몇 년인가?", "2년간", None), ("공사는 몇 개월?", "2024년 3월 5일", None), ("가격은 몇 원?", "2년", None),
    ("가격은 몇 원?", "300달러", ("원", "달러")), ("how many days", "3 weeks", ("days", "weeks")), ("언제인가?", "3주", None), ("비율은 몇 퍼센트?", "3배", ("퍼센트", "배")),
    ("몇 년?", "24개월", ("년", "개월")), ("How Many  years was it?", "24 months, 2 years", None), ("몇\u3000년", "1,200.5\u00a0일정도", ("년", "일")), ("몇 년?", "3월 5일", None),
    (None, "x", None), ("몇 년?", None, None), ("", "", None), ("몇 달러인가", "3만원", ("달러", "원")), ("how many daysX", "3 weeks", None), ("몇 년?", "3개월분", None), ("몇 시간?", "5분 쯤, 2시간", None),
]


def test_unit_mismatches(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, q, v) for i, (q, v, _) in enumerate(MEASURED)], "i long, q string, v string")
    rows = df.select("i", units.unit_mismatch(F.col("q"), F.col("v")).alias("m")).select("i", "m.asked", "m.stated").orderBy("i").collect()
    assert [(r["asked"], r["stated"]) for r in rows] == [want or (None, None) for _, _, want in MEASURED]


def test_policy_records_move_by_compare_and_set():
    one = pf.mark_policy(None, "a.", "t1")
    assert (one["revision"], pf.mark_policy(one, "a.", "t2")["revision"], pf.mark_policy(one, "a.", "t2")["first_seen"]) == (1, 1, "t1")
    two = pf.mark_policy(one, "b.", "t3", revision=1)
    assert two["revision"] == 2 and two["first_seen"] == "t3"
    with pytest.raises(pf.PolicyError):
        pf.mark_policy(two, "c.", "t4", revision=1)


def test_sqlite_and_query_files(spark, tmp_path):
    import sqlite3

    from tessera.sources import files

    path = str(tmp_path / "kb.db")
    with sqlite3.connect(path) as db:
        db.execute("create table facts (id integer primary key, subject text, confidence real, raw blob)")
        db.executemany("insert into facts values (?, ?, ?, ?)", [(i, f"s{i}" if i % 3 else None, i / 10, b"x") for i in range(100)])
        db.execute("create table empty (id integer)")
    got = files.read_sqlite(spark, path, "facts", pieces=7)
    assert got.count() == 100 and [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "binary"] and got.filter("subject is null").count() == 34
    assert files.read_sqlite(spark, path, "empty").count() == 0
    with pytest.raises(Exception):
        files.read_sqlite(spark, path, 'x"; drop').count()
    q = spark.createDataFrame([(2, "translated", "b."), (1, "translated", "a."), (3, "pending", "c."), (4, "translated", None)], "id long, status string, query_dl string")
    files.write_whole(str(tmp_path / "query.dl"), files.query_text(q))
    assert files.read_query(str(tmp_path / "query.dl")) == "a.\nb.\n" and files.read_query(str(tmp_path / "none.dl")) == "" and sorted(x.name for x in tmp_path.iterdir()) == ["kb.db", "query.dl"]
