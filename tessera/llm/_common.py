"""Shared plumbing of the training-data operators: table reading, shared scratch tables, column safety."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python kernel works on at once; one longer text is taken alone.
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, column: str = "text"):
    """Arrow batches cut into slices that are small in rows and in bytes of one column, without copying them.

    Spark bounds a batch by bytes; what a kernel derives from it is several times as large, hence the cut.
    """
    for batch in batches:
        lo, n = 0, batch.num_rows
        if not n:
            yield batch
        while lo < n:
            hi = min(lo + PIECE_ROWS, n)
            while hi - lo > 1 and batch.column(column).slice(lo, hi - lo).nbytes > PIECE_BYTES:
                hi = lo + (hi - lo) // 2
            yield batch.slice(lo, hi - lo)
            lo = hi


def need(df: DataFrame, **types: str) -> DataFrame:
    """Selects the named columns only, cast to the types given.

    Other columns, whatever their names, never enter the operator, so they cannot clash with its own.
    """
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it: a binding by a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A key with more than the HEAVY-th part of all rows is heavy, so fewer than HEAVY keys are.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups on key, however many rows a key has; how: inner, or left for groups without some keys.

    groups has one row a key and in copies how many of the total rows have it. By that sum fewer than HEAVY keys
    are heavy: their groups are broadcast and their rows stay where they are. A key of the others, which are
    shuffled, is a small part of all rows.
    """
    heavy = groups.filter(F.col(copies) * HEAVY > total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(groups.filter(F.col(copies) * HEAVY <= total), key, how))


def running(values: Column, merge, start: int) -> Column:
    """For each element of an array of numbers, it and all before it merged (sum, greatest), as longs.

    merge: an associative function of two columns with start as its neutral value. Appending to an array copies
    it, so values run inside blocks of some root of the length, and along the blocks: the work is the length to
    the power of 1.5, not its square.
    """
    zero, none = F.lit(start).cast("long"), F.expr("cast(array() as array<bigint>)")

    def along(array):
        grown = F.aggregate(
            array,
            F.struct(zero.alias("at"), none.alias("all")),
            lambda acc, v: F.struct(merge(acc["at"], v).alias("at"), F.array_append(acc["all"], merge(acc["at"], v)).alias("all")),
        )
        return grown["all"]

    def blocked(v):
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        inner = F.transform(F.sequence(F.lit(1), F.size(v), step), lambda s: along(F.slice(v, s, step)))

        def joined(blocks):
            ends = along(F.transform(blocks, lambda b: F.element_at(b, -1)))
            return bound(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: merge(x, F.coalesce(F.get(e, i - 1), zero))))))

        return F.when(F.size(v) < 32, along(v)).otherwise(bound(inner, joined))

    return bound(F.transform(values, lambda x: x.cast("long")), blocked)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_open: set[Scratch] = set()


@atexit.register
def close_all() -> None:
    """Removes all saved tables. It runs when the driver's Python ends; a long session calls it when no frame that an
    operator returned is read any more."""
    for scratch in list(_open):
        scratch.close()


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive the loss of any executor.

    ``drop`` removes tables that nothing reads any more. What a returned DataFrame still reads stays
    until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.live: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        _open.add(self)
        df.write.option("compression", "zstd").parquet(path)
        self.live.add(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def folder(self, name: str) -> str:
        """A path below this scratch folder, kept until the driver's Python ends."""
        _open.add(self)
        path = f"{self.root}/{name}"
        self.live.add(path)
        return path

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path in self.live:
                remove(self.spark, path)
                self.live.discard(path)
        if not self.live:
            self.close()

    def close(self) -> None:
        _open.discard(self)
        try:
            remove(self.spark, self.root)
        except Exception:  # the session has ended; the cluster cleans its checkpoint folder
            pass
