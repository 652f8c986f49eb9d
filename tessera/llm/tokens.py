"""Token counts through a digest cache.

The digest of a text's normalised content (null becomes the empty text; nothing else changes, as every
character counts for a tokenizer) and the digest of the tokenizer's file name a stored count. Documents join
the cache on both; only distinct texts that miss are encoded, and their counts are appended to the cache.

The cache is a folder of Parquet tables, `tokenizer=<digest>/run=<id>`: a run reads its own tokenizer's tables
alone and writes one of its own, so runs at the same time never touch each other's files.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, need, pieces, remove

CACHE_SCHEMA = "content binary, n_tokens long"
#: Texts handed to the encoder at once, in characters.
GROUP_CHARS = 1 << 21


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from texts to token counts; the library follows from the file's kind."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: another version never reads this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _encode(batches, path: str):
    count = _encoder(path)
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        out: list[int] = []
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                out += count(group)
                group, size = [], 0
        if group:
            out += count(group)
        yield pa.RecordBatch.from_arrays([batch.column("content").cast(pa.binary()), pa.array(out, pa.int64())], ["content", "n_tokens"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return need(docs, doc_id="long", text="string").select("doc_id", text.alias("text")).withColumn("content", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


def _add(keyed: DataFrame, known: DataFrame | None, at: str, tokenizer_path: str) -> DataFrame | None:
    """The counts of the distinct contents that are not known, encoded and stored as a new run; None where all are."""
    spark = keyed.sparkSession
    missing = keyed.select("content", "text")
    if known is not None:
        missing = missing.join(known.select("content"), "content", "left_anti")
    misses = missing.groupBy("content").agg(F.first("text").alias("text"))
    run = f"{at}/run={uuid.uuid4().hex}"
    misses.mapInArrow(functools.partial(_encode, path=tokenizer_path), CACHE_SCHEMA).write.option("compression", "zstd").parquet(run)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(run)
    if counts.isEmpty():
        remove(spark, run)
        return None
    return counts


def add_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str) -> None:
    """Stores the counts of all texts of docs in the cache; those that it holds are not encoded again."""
    at = f"{cache_dir}/tokenizer={tokenizer_digest(tokenizer_path)}"
    _add(_keyed(docs), _stored(docs.sparkSession, at), at, tokenizer_path)


def compact_cache(spark: SparkSession, tokenizer_path: str, cache_dir: str) -> None:
    """Puts the runs of a tokenizer together as one, each content once. For when no other run reads the cache: the
    old tables go when the new one is written, and a reader of them would miss them."""
    at = f"{cache_dir}/tokenizer={tokenizer_digest(tokenizer_path)}"
    runs = _runs(spark, at)
    if len(runs) > 1:
        whole = spark.read.schema(CACHE_SCHEMA).parquet(*runs).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        whole.write.option("compression", "zstd").parquet(f"{at}/run={uuid.uuid4().hex}")
        for old in runs:
            remove(spark, old)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_dir: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    cache_dir: a folder of earlier counts, read and added to; without one the counts are kept for this call
    alone. Null text counts as empty (0 tokens). A null doc_id stays null. Repeated rows and exact copies are
    encoded once and each gets its row. Columns other than doc_id and text are ignored. An empty table gives no
    rows. Runs at the same time may store a count twice: readers take one.
    """
    spark = docs.sparkSession
    own = Scratch(spark, "tokens")
    keyed = _keyed(docs)
    at = f"{cache_dir or own.folder('cache')}/tokenizer={tokenizer_digest(tokenizer_path)}"
    known = _stored(spark, at)
    counts = _add(keyed, known, at, tokenizer_path)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    if known is not None:
        # Of the earlier counts only those of these documents are taken; saved apart from their grouping, so that
        # the join below is a plain one, whose hot digests AQE splits.
        met = known.join(sized.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        earlier = own.save(met, "earlier")
        counts = earlier if counts is None else counts.unionByName(earlier)
    if counts is None:
        counts = spark.createDataFrame([], CACHE_SCHEMA)
    return sized.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _runs(spark: SparkSession, at: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    where = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in where.listStatus(path)] if where.exists(path) else []


def _stored(spark: SparkSession, at: str) -> DataFrame | None:
    """Counts that earlier runs stored for a tokenizer, a content perhaps more than once; None while there are none."""
    # The tables are named, so that what a run adds meanwhile is not read as known.
    runs = _runs(spark, at)
    return spark.read.schema(CACHE_SCHEMA).parquet(*runs) if runs else None
