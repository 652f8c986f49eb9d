"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of token positions, some of which are ignored. Under every mask each window of the
benchmark and of the documents is hashed over the kept positions only; equal hashes are hits, so a hit survives
substituted tokens at ignored positions. Hits are found by joining the two tables of hashes. Around them the
texts are aligned on the hits' diagonals and verified token by token.

An overlap is a stretch of a diagonal in which at least MIN_IDENTITY of the tokens are equal, MIN_MATCHED of them,
or SHORT_SHARE of an item too short for that. MASKS hit every stretch with MIN_MATCHED equal tokens and that
identity, wherever the substitutions stand; SHORT_MASKS do the same for each length of a short item. Tests
count this out over all patterns, so seeds lose no overlap.

What is sent to every task is one bitmap of the benchmark's hashes, of at most MOST_BITS bits whatever the
benchmark's size. It only keeps hashes that can't hit out of the shuffle: a benchmark that fills it means more
rows in the join, not fewer hits. Documents with a hit are kept once a text, by its digest. A text travels once for
thousands of its items and its windows are sorted once for them. To clean a corpus one overlap of a text is enough:
it is sought first in one item for each hash, so that a passage which many items share is verified once a text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ._common import HEAVY, Scratch, fresh, need, pieces
from ._words import _ODD, ALNUM, buffers, mix, words

MIN_MATCHED, MIN_IDENTITY, SHORT_SHARE = 13, 0.75, 0.8
#: 1 keeps a position.
MASKS = ["11101011", "10100100111", "1110000010011", "100010001111", "1011010000101", "111110001"]
#: The masks of an item by its number of tokens, where it is too short for MIN_MATCHED.
SHORT_MASKS = {
    1: ["1"],
    2: ["11"],
    3: ["111"],
    4: ["1111"],
    5: ["111", "1101"],
    6: ["1111", "11011"],
    7: ["11111", "111011", "110111"],
    8: ["111111", "1111011", "1101111"],
    9: ["1111011", "1101111"],
    10: ["111011", "11010011", "11111"],
    11: ["1111011", "110010111", "1101100101", "111111"],
    12: ["11101011", "101100111", "111111"],
    13: ["11101011", "11001111"],
    14: ["111010011", "1111011"],
    15: ["1111011", "11001000111", "11010110001"],
}
#: Bits of the bitmap for each hash of the benchmark, and at most.
BITS_A_HASH, MOST_BITS = 64, 1 << 27
#: Where the bits of a hash that the bitmap holds begin.
PROBES = (0, 17, 34)

HITS = "doc_id long, item_id long, matched long, overlap_tokens long, item_tokens long, doc_start long, item_start long, identity double"
#: Bits in one bitmap of Spark's bitmap functions.
BUCKET = 32768


def masks_of(n: int) -> list[str]:
    """The masks that find every overlap with an item of n tokens."""
    return SHORT_MASKS.get(n, MASKS) if n else []


def least_matched(n):
    """Equal tokens that an overlap with an item of n tokens needs."""
    return np.minimum(MIN_MATCHED, np.ceil(SHORT_SHARE * np.asarray(n) - 1e-9)).astype(np.int64)


def _tokens(column: pa.Array):
    data, bounds = buffers(column)
    h, _, _, own = words(data, bounds, ALNUM)
    return h, own


def _seeds(h: np.ndarray, text: np.ndarray, masks: list[str]):
    """For each mask: the hash of each window that lies inside one text, and its position. text: of each token."""
    heavy = max((m.count("1") for m in masks), default=0)
    turned = [h * _ODD[j] for j in range(heavy)]
    for mask in masks:
        kept, span = [i for i, c in enumerate(mask) if c == "1"], len(mask)
        n = len(h) - span + 1
        if n <= 0:
            continue
        out = np.full(n, int(mask, 2), dtype=np.uint64)
        for j, i in enumerate(kept):
            out += turned[j][i : i + n]
        at = np.flatnonzero(text[:n] == text[span - 1 :])
        yield mask, mix(out[at]), at


def _of_text(own: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(own) - 1), np.diff(own))


SEEDS = "item long, key long, mask string"


def _item_seeds(batches):
    """(item, key, mask): the distinct hashes of every item, under the masks of its length."""
    for batch in pieces(batches):
        h, own = _tokens(batch.column("text"))
        ids = np.asarray(batch.column("item"))
        cols: list[tuple] = []
        for i in range(len(own) - 1):
            part = h[own[i] : own[i + 1]]
            for mask, key, _ in _seeds(part, np.zeros(len(part), np.int8), masks_of(len(part))):
                key = np.unique(key)
                cols.append((np.full(len(key), ids[i]), key.view(np.int64), np.full(len(key), mask, dtype=object)))
        joined = [np.concatenate(c) if cols else np.zeros(0, np.int64) for c in (zip(*cols, strict=True) if cols else [()] * 3)]
        yield pa.RecordBatch.from_arrays([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), pa.array(joined[2].astype(str).tolist(), pa.string())], ["item", "key", "mask"])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bytes of the bitmap over all keys; BITS_A_HASH bits a key, MOST_BITS at most."""
    n = seeds.count()
    bits = BUCKET
    while bits < min(n * BITS_A_HASH, MOST_BITS):
        bits *= 2
    places = F.array(*[F.pmod(F.call_function("shiftrightunsigned", F.col("key"), F.lit(s)), F.lit(bits)) for s in PROBES])
    spots = seeds.select(F.explode(places).alias("bit")).withColumn("bucket", F.floor(F.col("bit") / BUCKET).cast("long"))
    # Spark's own bitmaps: at most MOST_BITS / BUCKET rows of 4 KB.
    parts = spots.groupBy("bucket").agg(F.bitmap_construct_agg((F.col("bit") % BUCKET).cast("long")).alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[r["bucket"] * (BUCKET // 8) : (r["bucket"] + 1) * (BUCKET // 8)] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def _may_hit(key: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bits are all set."""
    at = np.arange(len(key))
    for s in PROBES:
        bit = (key[at] >> np.uint64(s)) & np.uint64(len(bitmap) * 8 - 1)
        at = at[(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _hits(column: pa.Array, masks: list[str], bitmap: np.ndarray):
    """For each text its distinct hashes that may hit, as a list of arrays."""
    h, own = _tokens(column)
    text = _of_text(own)
    docs, keys = [], []
    for _, key, at in _seeds(h, text, masks):
        ok = _may_hit(key, bitmap)
        docs.append(text[at[ok]])
        keys.append(key[ok])
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    cuts = np.searchsorted(doc, np.arange(len(own)))
    return [key[cuts[i] : cuts[i + 1]] for i in range(len(own) - 1)]


def _suspects(batches, masks, bitmap, text: str, name: str):
    """The rows with a hash that may hit, and these hashes in a further column."""
    for batch in pieces(batches, text):
        keys = _hits(batch.column(text), masks, bitmap)
        hit = np.array([len(k) > 0 for k in keys], dtype=bool)
        held = pa.array([k for k in keys if len(k)], pa.list_(pa.int64()))
        yield batch.filter(pa.array(hit)).drop_columns([text]).append_column(name, held)


def _clean(batches, masks, bitmap, text: str):
    """The rows without any."""
    for batch in pieces(batches, text):
        hit = np.array([len(k) > 0 for k in _hits(batch.column(text), masks, bitmap)], dtype=bool)
        yield batch.filter(pa.array(~hit)).drop_columns([text])


def best_stretch(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(matched, start, end) of the overlap of a diagonal with most equal tokens, then the shortest, then the first.

    With 1 for an equal token and -3 for another, identity is at least 3/4 where a stretch sums to 0 or more. For
    each end the first start that does is the best one.
    """
    won = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(won)
    start = np.searchsorted(-low, -won, "left")
    equal = np.concatenate([[0], np.cumsum(same)])
    matched = equal - equal[start]
    if not len(same) or matched.max() < max(least, 1):
        return None
    best = None
    at = np.flatnonzero(same)
    for e in np.flatnonzero(matched == matched.max()):
        # Trimmed to equal tokens at both ends.
        a, b = int(at[equal[start[e]]]), int(at[equal[e] - 1]) + 1
        if best is None or b - a < best[2] - best[1]:
            best = (int(matched[e]), a, b)
    return best


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers in a sorted array."""
    cut = np.flatnonzero(np.diff(x) > 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]


class _Sought:
    """A text whose windows are looked up many times: its hashes are sorted once for each choice of masks."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.sorted = tokens, {}

    def windows(self, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the windows under all these masks, in the order of the hashes, then of the positions."""
        if masks not in self.sorted:
            found = [(key, at) for _, key, at in _seeds(self.tokens, np.zeros(len(self.tokens), np.int8), list(masks))]
            key, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(key, kind="stable")
            self.sorted[masks] = key[order], at[order]
        return self.sorted[masks]


def _item_windows(b: np.ndarray):
    """(masks, hashes, place, places) of an item: its masks, its distinct hashes under them (which tell masks apart),
    the position of each that has one and else -1, and all positions."""
    masks = tuple(masks_of(len(b)))
    key, at = _Sought(b).windows(masks)
    kept, first, n = np.unique(key, return_index=True, return_counts=True)
    return masks, kept, np.where(n == 1, at[first], -1), np.split(at, first[1:])


def _diagonals(a: _Sought, b: np.ndarray, windows) -> np.ndarray:
    """The distinct places of b's start along a on which some seed of the item b hits a.

    Runs of windows with one hash, as of repeated tokens, meet as runs: their diagonals are one range, and such
    ranges are counted along all places of a.
    """
    masks, keys, place, places = windows
    ka, pa_ = a.windows(masks)
    left, right = np.searchsorted(ka, keys, "left"), np.searchsorted(ka, keys, "right")
    once = (right - left == 1) & (place >= 0)
    alone, many = pa_[left[once]] - place[once], np.flatnonzero((right > left) & ~once)
    if not len(many):
        return np.unique(alone)
    edge = np.zeros(len(a.tokens) + len(b) + 2, np.int64)
    np.add.at(edge, alone + len(b), 1)
    np.add.at(edge, alone + len(b) + 1, -1)
    for k in many:
        a1, a2 = _runs(pa_[left[k] : right[k]])
        for lo, hi in zip(*_runs(places[k]), strict=True):
            np.add.at(edge, a1 - hi + len(b), 1)
            np.add.at(edge, a2 - lo + len(b) + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0) - len(b)


def overlap(a: np.ndarray | _Sought, b: np.ndarray, windows=None) -> tuple | None:
    """(matched, length, item tokens, start in a, start in b) of the best overlap of a text a with an item b."""
    sought = a if isinstance(a, _Sought) else _Sought(a)
    a, least, best = sought.tokens, int(least_matched(len(b))), None
    for d in _diagonals(sought, b, _item_windows(b) if windows is None else windows).tolist():
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = a[lo + d : hi + d] == b[lo:hi]
        found = best_stretch(same, least) if hi - lo >= least and np.count_nonzero(same) >= least else None
        if found:
            matched, s, e = found
            row = (matched, s - e, -(lo + s + d), -(lo + s))
            best = max(best, row) if best else row
            if matched == len(b):  # the whole item, at its first place: diagonals rise with the place in a
                break
    return best and (best[0], -best[1], len(b), -best[2], -best[3])


FOUND = "digest binary, item long, matched long, overlap_tokens long, item_tokens long, doc_start long, item_start long"
#: Items of one text that one task verifies, and items whose windows a task keeps.
BLOCK, KEPT_ITEMS = 4096, 4096


def _verify(batches, first: bool):
    """FOUND of texts followed by the items that may overlap them, as _verified() orders the rows.

    first: one overlap of a text is enough, so its further items are passed over.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]
    at, sought, done, known = None, None, False, {}
    for batch in pieces(batches):
        h, own = _tokens(batch.column("text"))
        digest, block, item, out = *(batch.column(c).to_pylist() for c in ("digest", "block", "item")), []
        for i in range(batch.num_rows):
            tokens = h[own[i] : own[i + 1]]
            if item[i] is None:
                at, sought, done = (digest[i], block[i]), _Sought(tokens.copy()), False
                continue
            if at != (digest[i], block[i]):
                raise ValueError("an item without its text")
            if done:
                continue
            if item[i] not in known:
                if len(known) >= KEPT_ITEMS:
                    known.clear()
                known[item[i]] = _item_windows(tokens)
            if r := overlap(sought, tokens, known[item[i]]):
                out.append((digest[i], item[i], *r))
                done = first
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.binary() if not j else pa.int64()) for j in range(len(names))], names)


def _meet(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(digest, item, shared) of texts and items with equal hashes.

    A hash that more than the HEAVY-th part of all hits have is dealt to as many tasks as it has such parts; fewer
    than HEAVY hashes are, so their list is broadcast.
    """
    total = max(1, hits.count())
    heavy = hits.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * HEAVY > total)
    parts = F.broadcast(heavy.select("key", F.ceil(F.col("n") * HEAVY / total).cast("int").alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    left = hits.join(parts, "key", "left").select("digest", "key", F.pmod(F.xxhash64("digest"), n).cast("int").alias("part"))
    right = seeds.join(parts, "key", "left").select("item", "key", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return left.join(right, ["key", "part"]).groupBy("digest", "item").agg(F.count("*").alias("shared"))


def _verified(tmp: Scratch, pairs: DataFrame, texts: DataFrame, items: DataFrame, first: bool, name: str) -> DataFrame:
    """FOUND of the pairs that overlap, as a saved table. A text travels once for BLOCK of its items, and they after
    it, those with most equal hashes ahead."""
    pairs = tmp.save(pairs, "pairs")
    many = pairs.groupBy("digest").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    at = texts.join(many, "digest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = at.select("digest", "block", F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("shared"), "text")
    listed = pairs.join(many.filter("blocks > 1"), "digest", "left").withColumn("block", F.pmod(F.xxhash64("item"), F.coalesce("blocks", F.lit(1))).cast("int"))
    followers = listed.select("digest", "block", "item", "shared").join(items.select("item", "text"), "item").select("digest", "block", "item", "shared", "text")
    rows = heads.unionByName(followers).repartition("digest", "block").sortWithinPartitions("digest", "block", F.col("item").isNotNull(), F.desc("shared"), "item")
    found = tmp.save(rows.mapInArrow(functools.partial(_verify, first=first), FOUND), name)
    tmp.drop(pairs)
    return found


def _suspected(tmp: Scratch, docs: DataFrame, benchmark: DataFrame):
    """(suspects, hits, texts, items, seeds, masks, bitmap, digest, keys); None for a benchmark without tokens.

    suspects: the rows of docs that may hit, with their digest and hashes in the columns so named; hits: digest,
    key; texts: digest, text; items: item, item_id, text; seeds: item, key.
    """
    known = need(benchmark, item_id="long", text="string").filter(F.col("text").isNotNull()).distinct()
    items = tmp.save(known.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = tmp.save(items.select("item", "text").mapInArrow(_item_seeds, SEEDS), "seeds")
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())
    if not masks:
        return None
    bitmap = _bitmap(seeds.select("key").distinct())
    text, keys, digest = (fresh(docs, n) for n in ("__text", "__keys", "__digest"))
    schema = StructType([*docs.schema.fields, StructField(keys, ArrayType(LongType()))])
    marked = docs.withColumn(text, F.col("text").cast("string")).mapInArrow(functools.partial(_suspects, masks=masks, bitmap=bitmap, text=text, name=keys), schema)
    suspects = tmp.save(marked.withColumn(digest, F.unhex(F.md5(F.col("text").cast("string").cast("binary")))), "suspects")
    hits = tmp.save(suspects.select(F.col(digest).alias("digest"), F.explode(keys).alias("key")).distinct(), "hits")
    texts = suspects.groupBy(F.col(digest).alias("digest")).agg(F.first(F.col("text").cast("string")).alias("text"))
    return suspects, hits, texts, items, seeds.select("item", "key").distinct(), masks, bitmap, digest, keys


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, the best of each document and item: doc_id, item_id, matched, overlap_tokens,
    item_tokens, doc_start, item_start (tokens from 0) and identity (matched / overlap_tokens).

    Best: most equal tokens, then the shortest stretch, then the first. Tokens are runs of ASCII digits and
    letters (A-Z as a-z) and characters beyond ASCII. Null and empty texts and items overlap nothing. Repeated
    rows of a document repeat its overlaps, repeated items count once. Other columns are ignored; an empty table
    on either side gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "decontam")
    got = _suspected(tmp, need(docs, doc_id="long", text="string"), benchmark)
    if got is None:
        return docs.sparkSession.createDataFrame([], HITS)
    suspects, hits, texts, items, seeds, _, _, digest, _ = got
    found = _verified(tmp, _meet(hits, seeds), texts, items, False, "found")
    tmp.drop(hits)
    named = found.join(items.select("item", "item_id"), "item")
    out = suspects.select("doc_id", F.col(digest).alias("digest")).join(named, "digest")
    kept = [c.split()[0] for c in HITS.split(", ")[:-1]]
    return out.select(*kept, (F.col("matched") / F.col("overlap_tokens")).alias("identity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no verified overlap, with all their columns; each row is judged alone.

    Rows without a hash that may hit are passed on where they are; only the others are joined with the verdicts.
    """
    tmp = Scratch(docs.sparkSession, "decontam")
    got = _suspected(tmp, docs, benchmark)
    if got is None:
        return docs
    suspects, hits, texts, items, seeds, masks, bitmap, digest, keys = got
    # First one item for each hash: what many items share is found in one of them. Then all items, for the rest.
    firsts = seeds.groupBy("key").agg(F.min("item").alias("item"))
    bad = _verified(tmp, _meet(hits, firsts), texts, items, True, "first").select("digest").distinct()
    rest = tmp.save(hits.join(bad, "digest", "left_anti"), "rest")
    more = _verified(tmp, _meet(rest, seeds), texts.join(rest.select("digest").distinct(), "digest", "left_semi"), items, True, "more")
    text, gone = fresh(docs, "__text"), fresh(docs, "__gone")
    clean = docs.withColumn(text, F.col("text").cast("string")).mapInArrow(functools.partial(_clean, masks=masks, bitmap=bitmap, text=text), docs.schema)
    bad = bad.union(more.select("digest")).distinct().select(F.col("digest").alias(gone))
    tmp.drop(hits, rest)
    return clean.unionByName(suspects.join(bad, F.col(digest) == F.col(gone), "left_anti").drop(digest, keys))
