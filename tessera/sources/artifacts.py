"""A content-addressed sink for extracted texts, as a Spark data source with a two-phase commit.

Every text becomes the file <folder>/artifacts/sources/<source_id>/<sha256>.txt. A task writes under a name of its
own and moves the whole file into place; as the name follows from the content, retries, speculative attempts and
reruns come to the same files. What a job wrote is listed by the driver in one manifest, written only when all tasks
are done: readers go by manifests, so nothing of a job that failed is ever read.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import terms
from ..functions import text

ROWS = "source_id long, text string"
STORED = "source_id long, path string, checksum string, bytes long"
TEXTS = "source_id long, path string, checksum string, text string"
MANIFESTS = "_manifests"
#: Bytes of texts in one batch that goes back to Spark (a fixed value); a longer text is a batch of its own.
BATCH = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; one of our own only in local mode, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def _put(where, path: str, data: bytes) -> bool:
    """Writes a file so that readers see all of it or nothing; False where it was there already."""
    if where.get_file_info(path).type == fs.FileType.File:
        return False
    part = f"{path}.{uuid.uuid4().hex}.part"
    where.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with where.open_output_stream(part) as out:
            out.write(data)
        where.move(part, path)
    except BaseException:
        if where.get_file_info(part).type == fs.FileType.File:
            where.delete_file(part)
        raise
    return True


@dataclass
class _Wrote(WriterCommitMessage):
    rows: list


class _Writer(DataSourceArrowWriter):
    """Takes Arrow batches and makes one text at a time of them, in NFC, so a task holds a batch once and not as rows
    beside it, nor in a second worker that would normalize it."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        where, root = _at(self.folder)
        done = []
        for batch in iterator:
            for source, text_ in zip(batch.column("source_id"), batch.column("text"), strict=True):
                if not source.is_valid or not text_.is_valid:
                    continue
                source_id, data = source.as_py(), text_.as_buffer().to_pybytes()
                if not data.isascii():
                    data = terms.nfc(data.decode("utf-8")).encode("utf-8")
                digest = hashlib.sha256(data).hexdigest()
                path = f"artifacts/sources/{source_id}/{digest}.txt"
                _put(where, f"{root}/{path}", data)
                done.append((source_id, path, digest, len(data)))
        return _Wrote(done)

    def commit(self, messages):
        where, root = _at(self.folder)
        rows = sorted({r for m in messages if m is not None for r in m.rows})
        lines = "\n".join(json.dumps(dict(zip(("source_id", "path", "checksum", "bytes"), r, strict=True))) for r in rows)
        _put(where, f"{root}/{MANIFESTS}/{uuid.uuid4().hex}.json", lines.encode())

    def abort(self, messages):
        """Nothing to take back: files without a manifest are read by nobody, and a rerun finds them in place."""


class ArtifactSink(DataSource):
    """Spark sink "artifacts": rows of ROWS, option folder (a URI that executors reach). Only mode append."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("artifacts are only added")
        return _Writer(self.options["folder"])


def store_artifacts(sources: DataFrame, folder: str) -> None:
    """Writes the text of every row (source_id, text) whose artifact is not listed yet; rows without a text or an id
    have none. Text is NFC, with NUL characters replaced, so digest and file are of one value."""
    spark = sources.sparkSession
    spark.dataSource.register(ArtifactSink)
    clean = sources.select(F.col("source_id").cast("long").alias("source_id"), text.sanitize(F.col("text"))["text"].alias("text"))
    plain = clean.filter("text is not null and source_id is not null")
    listed = stored_artifacts(spark, folder)
    if listed is not None:
        k = ["source_id", "checksum"]
        plain = plain.withColumn("text", F.when(F.rlike("text", F.lit(r"[^\x00-\x7F]")), text.nfc(F.col("text"))).otherwise(F.col("text"))).withColumn("checksum", F.sha2("text", 256)).join(listed.select(*k), k, "left_anti").select("source_id", "text")
    plain.write.format("artifacts").option("folder", folder).mode("append").save()


def stored_artifacts(spark: SparkSession, folder: str) -> DataFrame | None:
    """STORED, each artifact once, of all jobs that were committed; None before the first."""
    where, root = _at(folder)
    if where.get_file_info(f"{root}/{MANIFESTS}").type != fs.FileType.Directory:
        return None
    return spark.read.schema(STORED).json(f"{folder}/{MANIFESTS}").distinct()


def _texts(batches):
    """The listed rows with their text, BATCH bytes of texts at a time; a file that is gone, or not what its name says, raises."""
    for batch in batches:
        rows, start, texts, size = batch.drop_columns(["folder"]), 0, [], 0
        for n, (folder, path, checksum) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "checksum")), strict=True)):
            where, root = _at(folder)
            try:
                with where.open_input_stream(f"{root}/{path}") as f:
                    data = f.read()
            except FileNotFoundError:
                data = None
            if data is None or hashlib.sha256(data).hexdigest() != checksum:
                raise ValueError(f"a broken artifact: {path}")
            if texts and size + len(data) > BATCH:
                yield rows.slice(start, n - start).append_column("text", pa.array(texts, pa.string()))
                start, texts, size = n, [], 0
            texts.append(data.decode("utf-8"))
            size += len(data)
        yield rows.slice(start).append_column("text", pa.array(texts, pa.string()))


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, path, checksum, text of every artifact that a manifest lists; a text that is not what its name says
    fails the job, as does a listed artifact without a file. Tasks open the files that the manifests name, so no
    folder is listed."""
    listed = stored_artifacts(spark, folder)
    if listed is None:
        return spark.createDataFrame([], TEXTS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("source_id", "path", "checksum", F.lit(folder).alias("folder")).repartition(tasks, "path").mapInArrow(_texts, TEXTS)
