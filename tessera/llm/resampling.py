"""Target-distribution importance resampling.

Documents are drawn in proportion to how much likelier their n-grams are in a target text than in the pool, with
hashed n-grams as features and Gumbel noise for a draw without replacement.

Identical texts are one row for all that depends on the text only: texts are grouped whole, features and weight
are computed once a text, its features count as often as the text occurs, and the weights are joined back to the
documents. Only then does noise, which belongs to a document and not to a text, come in. Ranks come from a range
partitioning of the rows that may be drawn: a row's place in its partition plus the rows of those before it.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fresh, join_groups, need, pieces
from ._words import ALNUM, word_codes

# Fixed values of the task's contract.
BUCKETS, LONGEST, SEED, LEAST_WORDS, DRAWN = 10000, 3, 42, 20, (5, 100)
#: Rows in one partition of the ranking, and the relative accuracy of the quantile that cuts rows too low to be drawn.
RANK_ROWS, ACCURACY = 200_000, 10_000
#: Bits of a row's place in its partition, in Spark's monotonically increasing ids.
PLACE = 33

COUNTS = "bucket int, n long"
WEIGHED = "digest binary, copies long, n_words long, n_features long, weight long"


@functools.cache
def _zeros(k: int) -> np.ndarray:
    """For each of the four bytes of a CRC register the register after 2**k zero bytes more."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    register = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    return one[register & 255] ^ (register >> 8) if k == 0 else _after(_after(register, k - 1), k - 1)


def _after(crc: np.ndarray, k: int) -> np.ndarray:
    z = _zeros(k)
    return z[0][crc & 255] ^ z[1][(crc >> 8) & 255] ^ z[2][(crc >> 16) & 255] ^ z[3][crc >> 24]


def joined_crc(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of the joined bytes of a and b, from that of a, that of b (more) and b's length."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _after(out[at], k)
    return out ^ more


def _features(column: pa.Array):
    """(bucket, text) of every run of 1 to LONGEST words of a column of texts, one array for each length of a run."""
    codes, own, distinct = word_codes(column, ALNUM)
    text = np.repeat(np.arange(len(own) - 1), np.diff(own))
    said = [w.encode() for w in distinct.to_pylist()]
    alone = np.array([zlib.crc32(w) for w in said], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in said], dtype=np.uint32)
    length = np.array([len(w) + 1 for w in said], dtype=np.int64)
    crc, out = alone[codes], []
    for n in range(1, LONGEST + 1):
        if n > 1:
            last = codes[n - 1 :]
            crc = joined_crc(crc[:-1], spaced[last], length[last]) if len(crc) else crc
        whole = text[: len(crc)] == text[n - 1 :]
        out.append(((crc[whole] % BUCKETS).astype(np.int64), text[: len(crc)][whole]))
    return out, np.diff(own)


def _count(batches):
    """(bucket, n) over a whole partition; a text counts as often as it occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in pieces(batches):
        copies = np.asarray(batch.column("copies"), dtype=np.int64)
        for bucket, text in _features(batch.column("text"))[0]:
            # In two halves, as bincount adds doubles.
            times = copies[text]
            for half, unit in ((times & 0xFFFFFF, 1), (times >> 24, 1 << 24)):
                if half.any():
                    total += np.bincount(bucket, half, BUCKETS).astype(np.int64) * unit
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])


def _weigh(batches, gains):
    """WEIGHED: of every text its number of words and features and the sum of their gains."""
    for batch in pieces(batches):
        found, words = _features(batch.column("text"))
        n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for bucket, text in found:
            n += np.bincount(text, minlength=batch.num_rows)
            weight += np.bincount(text, gains[bucket], batch.num_rows).astype(np.int64)
        cols = [batch.column("digest"), batch.column("copies"), *(pa.array(x, pa.int64()) for x in (words, n, weight))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in WEIGHED.split(", ")])


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the logarithm, in thousandths, of how much more often it is in the target than in the pool."""
    s, t = int(pool.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s) / (float(a + 1) * float(t)))) for a, b in zip(pool.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(tmp: Scratch, df: DataFrame, name: str) -> DataFrame:
    """(text, copies, digest) of the distinct texts; copies meet before the shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    grouped = df.select(text).groupBy("text").agg(F.count("*").alias("copies"))
    return tmp.save(grouped.withColumn("digest", _digest(F.col("text"))), name)


def _histogram(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each of the BUCKETS buckets, which is all that reaches the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text", "copies").mapInArrow(_count, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _weighed(tmp: Scratch, docs: DataFrame, target: DataFrame) -> DataFrame:
    """WEIGHED of the distinct texts of docs."""
    texts, goal = _texts(tmp, docs, "texts"), _texts(tmp, target, "goal")
    gain = gains(_histogram(texts), _histogram(goal))
    out = tmp.save(texts.mapInArrow(functools.partial(_weigh, gains=gain), WEIGHED), "weighed")
    tmp.drop(texts, goal)
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and doc_id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def _scored(docs: DataFrame, weighed: DataFrame, digest: str, seed: int) -> DataFrame:
    """docs with the columns of WEIGHED and score."""
    total = weighed.agg(F.sum("copies")).first()[0] or 0
    return join_groups(docs, weighed.withColumnRenamed("digest", digest), digest, "copies", total).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _ranked(tmp: Scratch, scored: DataFrame, least_words: int, share: tuple[int, int]) -> tuple[DataFrame, int]:
    """(scored with rank, number drawn). scored: a saved table with the columns score, doc_id, n_words and tie."""
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count()
    draw = share[0] * n // share[1]
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return none, 0
    at = max(0.0, 1 - draw / n - 2 / ACCURACY)
    least = scored.filter(able).agg(F.percentile_approx("score", F.lit(at), F.lit(ACCURACY))).first()[0]
    may = able & (F.col("score") >= least)
    top = scored.filter(may).count()
    if top < draw:
        may, top = able, n
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    parts = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-top // RANK_ROWS))
    placed = tmp.save(scored.filter(may).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    # One row a partition, whatever the number of documents.
    part = F.shiftright("at", PLACE)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << PLACE) - 1) + 1
    first = placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= draw, rank)).drop("part", "before", "at")
    return first.unionByName(none.filter(~may)), draw


def importance_report(docs: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAWN) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Words are runs of ASCII digits and letters (A-Z as a-z) and characters beyond ASCII; features are runs of one
    to three words, in BUCKETS buckets by crc32. Drawn are the share of those of least_words words or more with
    the highest scores, ties to the smaller doc_id, null ids last; equal rows take ranks in any order among
    themselves. A null text has no words, a null id counts as empty in the noise. Repeated rows are documents of
    their own; an empty target leaves the gain to the pool alone; other columns are ignored; an empty table gives
    no rows.
    """
    tmp = Scratch(docs.sparkSession, "resampling")
    plain = need(docs, doc_id="long", text="string")
    weighed = _weighed(tmp, plain, target)
    keyed = plain.select("doc_id", _digest(F.coalesce("text", F.lit(""))).alias("digest"))
    scored = tmp.save(_scored(keyed, weighed, "digest", seed).drop("digest", "copies").withColumn("tie", F.monotonically_increasing_id()), "scored")
    tmp.drop(weighed)
    ranked, _ = _ranked(tmp, scored, least_words, share)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAWN) -> DataFrame:
    """The drawn rows of docs with all their columns; rows that equal the last one drawn in score and id stay too."""
    tmp = Scratch(docs.sparkSession, "resampling")
    plain = need(docs, doc_id="long", text="string")
    weighed = _weighed(tmp, plain, target)
    keyed = plain.select("doc_id", _digest(F.coalesce("text", F.lit(""))).alias("digest"))
    scored = tmp.save(_scored(keyed, weighed, "digest", seed).withColumn("tie", F.monotonically_increasing_id()), "scored")
    ranked, draw = _ranked(tmp, scored, least_words, share)
    key, of = fresh(docs, "__digest"), fresh(docs, "__doc")
    drawn = ranked.filter(F.col("rank").isNotNull()).groupBy(F.col("doc_id").alias(of), F.col("digest").alias(key)).agg(F.lit(1)).select(of, key)
    rows = docs.withColumn(key + "_", _digest(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(drawn, (F.col(key + "_") == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of)), "left_semi").drop(key + "_")
