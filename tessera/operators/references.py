"""References between the tables of a knowledge base: what deleting or merging a row does to all others.

Deletes and merges take tables of ids, so that any number of sources goes or merges at once, as semi and anti joins
along the references. A change is a function from all tables to all tables; nothing is half done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .store import repoint

CASCADE, UNSET = "cascade", "unset"
#: (table, column, table it refers to, what becomes of a row whose referent goes), parents before children. Facts go
#: with their source although the reference alone would leave them: a fact without its citation is none.
REFERENCES = [
    ("artifacts", "source_id", "sources", CASCADE), ("jobs", "source_id", "sources", CASCADE), ("jobs", "artifact_id", "artifacts", UNSET),
    ("chunks", "source_id", "sources", CASCADE), ("chunks", "job_id", "jobs", CASCADE),
    ("facts", "source_id", "sources", CASCADE), ("facts", "job_id", "jobs", UNSET),
    ("terms", "fact_id", "facts", CASCADE), ("evidence", "fact_id", "facts", CASCADE), ("evidence", "source_id", "sources", CASCADE),
    ("evidence", "artifact_id", "artifacts", UNSET), ("evidence", "job_id", "jobs", UNSET), ("evidence", "chunk_id", "chunks", UNSET),
    ("events", "fact_id", "facts", UNSET), ("events", "source_id", "sources", UNSET), ("events", "job_id", "jobs", UNSET), ("events", "chunk_id", "chunks", UNSET),
]


def _of(tables: dict[str, DataFrame], name: str):
    """The references of a table that its columns and the given tables allow."""
    return [(c, parent, how) for t, c, parent, how in REFERENCES if t == name and parent in tables and c in tables[name].columns]


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, column, id, refers_to) of every reference whose row does not exist; id is null in a table without."""
    out = []
    for name, df in tables.items():
        for column, parent, _ in _of(tables, name):
            lost = df.filter(F.col(column).isNotNull()).join(tables[parent].select(F.col("id").alias("__there")), F.col(column) == F.col("__there"), "left_anti")
            own = F.col("id") if "id" in df.columns else F.lit(None)
            out.append(lost.select(F.lit(name).alias("name"), F.lit(column).alias("column"), own.cast("long").alias("id"), F.col(column).cast("long").alias("refers_to")))
    return reduce(DataFrame.unionByName, out)


def delete(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the rows of gone (table name: frame with id) and all that hangs on them are deleted.

    A row goes if it is in gone or a cascading reference of it leads to a row that goes; other references to rows
    that go become null. Ids that no row has delete nothing by themselves. Dangling references stay as they were.
    """
    order = list(dict.fromkeys([p for _, _, p, _ in REFERENCES if p == "sources"] + [t for t, *_ in REFERENCES]))
    lost: dict[str, DataFrame] = {}
    out = dict(tables)
    for name in [n for n in order if n in tables]:
        df, refs = tables[name], [r for r in _of(tables, name) if r[1] in lost]
        parts = [df.join(gone[name].select("id").distinct(), "id", "left_semi").select("id")] if name in gone else []
        for column, parent, how in refs:
            if how == CASCADE:
                hit = lost[parent].select(F.col("id").alias("__gone"))
                if "id" in df.columns:
                    parts.append(df.join(hit, F.col(column) == F.col("__gone"), "left_semi").select("id"))
                out[name] = out[name].join(hit, F.col(column) == F.col("__gone"), "left_anti")
        if name in gone:
            out[name] = out[name].join(gone[name].select("id").distinct(), "id", "left_anti")
        for column, parent, how in refs:
            if how == UNSET:
                hit = lost[parent].select(F.col("id").alias("__gone"))
                at = out[name].join(hit, F.col(column) == F.col("__gone"), "left")
                out[name] = at.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone").select(*df.columns)
        if parts:
            lost[name] = reduce(DataFrame.unionByName, parts).distinct()
    return out


# -- identities of sources ---------------------------------------------------------------------------------------

READY, MIXED, ACTIVE, DISTINCT, UNPROVABLE = "ready", "mixed_source_kind", "active_extraction_job", "distinct_paths", "unprovable_path"


def identity_groups(sources: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """canonical_path, id, kept_id, status of the sources whose paths are one in NFC and not all in that form.

    kept_id: the least id that has the path in NFC, else the least. Only a ready group may merge: its sources have
    one kind, none has a pending or running job, and files (path, checksum) shows the same bytes at every path; a
    path without a checksum proves nothing. Paths in ASCII are in NFC already and never leave the JVM.
    """
    plain = ~F.rlike("path", F.lit(r"[^\x00-\x7F]"))
    odd = sources.filter(~plain).withColumn("npath", text.nfc(F.col("path")))
    named = sources.filter(plain).withColumn("npath", F.col("path")).unionByName(odd)
    busy = jobs.filter(F.col("status").isin("pending", "running")).select(F.col("source_id").alias("id")).distinct().withColumn("busy", F.lit(True))
    sums = files.groupBy("path").agg(F.max("checksum").alias("checksum"))
    at = named.join(busy, "id", "left").join(sums, "path", "left")
    canonical = F.col("path") == F.col("npath")
    groups = at.groupBy("npath").agg(
        F.coalesce(F.min(F.when(canonical, F.col("id"))), F.min("id")).alias("kept_id"),
        F.count("*").alias("n"), F.min(canonical).alias("settled"), F.count_distinct("kind").alias("kinds"), F.coalesce(F.max("busy"), F.lit(False)).alias("busy"),
        F.count_distinct("checksum").alias("sums"), F.count("checksum").alias("proved"),
    ).filter((F.col("n") > 1) & ~F.col("settled"))
    status = F.when(F.col("kinds") > 1, MIXED).when(F.col("busy"), ACTIVE).when(F.col("proved") < F.col("n"), UNPROVABLE).when(F.col("sums") > 1, DISTINCT).otherwise(READY)
    return named.select("npath", "id").join(groups.select("npath", "kept_id", status.alias("status")), "npath").select(F.col("npath").alias("canonical_path"), "id", "kept_id", "status")


def merge_sources(tables: dict[str, DataFrame], groups: DataFrame) -> dict[str, DataFrame]:
    """All tables after the ready groups merged: references lead to the source kept, which has the path in NFC.

    An artifact of a merged source that the kept one has too, by kind and checksum, goes, and references lead to the
    least id of those. Every other row stays, none loses its source. A second run finds nothing to do.
    """
    ready = groups.filter(F.col("status") == READY)
    moves = ready.filter("id <> kept_id").select("id", "kept_id")
    out = dict(tables)
    for name, df in tables.items():
        if name != "sources" and "source_id" in df.columns:
            out[name] = repoint(df, moves).select(*df.columns)
    s = tables["sources"]
    paths = ready.filter("id = kept_id").select(F.col("id").alias("__id"), F.col("canonical_path").alias("__path"))
    left = s.join(moves.select("id"), "id", "left_anti").join(paths, F.col("id") == F.col("__id"), "left")
    out["sources"] = left.withColumn("path", F.coalesce("__path", "path")).drop("__id", "__path").select(*s.columns)
    if "artifacts" in tables:
        touched = ready.select("kept_id").distinct().withColumnRenamed("kept_id", "source_id")
        a = out["artifacts"].join(touched, "source_id", "left_semi").filter(F.col("checksum").isNotNull())
        # Of one source before the merge an artifact stays its own; the kept source's goes first.
        own = tables["artifacts"].select(F.col("id").alias("__own"), F.col("source_id").alias("__before"))
        a = a.join(own, F.col("id") == F.col("__own")).withColumn("moved", F.col("__before") != F.col("source_id"))
        kept = a.filter("not moved").groupBy("source_id", "kind", "checksum").agg(F.min("id").alias("first"))
        moved = a.filter("moved").groupBy("source_id", "kind", "checksum").agg(F.min("id").alias("other"))
        to = moved.join(kept, ["source_id", "kind", "checksum"], "left").select("source_id", "kind", "checksum", F.coalesce("first", "other").alias("to"))
        same = a.filter("moved").select("id", "source_id", "kind", "checksum").join(to, ["source_id", "kind", "checksum"]).filter(F.col("id") != F.col("to"))
        swaps = same.select("id", F.col("to").alias("kept_id"))
        out["artifacts"] = out["artifacts"].join(swaps.select("id"), "id", "left_anti").select(*tables["artifacts"].columns)
        for name in ("jobs", "evidence"):
            if name in tables and "artifact_id" in tables[name].columns:
                out[name] = repoint(out[name], swaps, "artifact_id").select(*tables[name].columns)
    return out


def merge_log(groups: DataFrame) -> DataFrame:
    """canonical_path, kept_id and the retired ids of every ready group. Spellings of one path are few."""
    retired = groups.filter((F.col("status") == READY) & (F.col("id") != F.col("kept_id")))
    return retired.groupBy("canonical_path", "kept_id").agg(F.array_sort(F.collect_list("id")).alias("retired"))
