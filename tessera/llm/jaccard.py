"""Exact n-gram Jaccard self-join by partitioning the shingle universe (pigeonhole).

Two sets of sizes s >= t with Jaccard >= J differ in at most H = floor((1-J)/(1+J) * (s+t)) elements. Sizes fall
into bands; a band's scheme cuts the hash universe into m segments, so that a set is m sub-sets. d of these
segments also index their one-deletion neighbourhoods. A plain segment tells two sets apart only by one
difference or more, one with deletions only by two or more; where the segments used weigh more than H together
(one each, two with deletions), some segment of every linked pair must agree (equal, or equal after one deletion
on either side). Allocation by cost happens twice: a band's d weighs index rows against expected chance
agreements, from the number of its classes; and each set leaves out its weakest segments, those of fewest
shingles, which strangers share, as far as the weight allows. A set takes part in its own band's scheme and in
the lower one where it may link down to.

Equal sets are one class before anything else, so exact copies cost nothing. Candidate pairs are never all
pairs of a bucket: first every member is verified against the bucket's most connected class, linked classes
become components, and only pairs of a bucket that are still in different components are looked at again, behind
an exact lower bound of their difference (parity sketch). Every link is verified on the whole shingle sets.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import Scratch, fresh, need, pieces
from ._words import mix, shingle_sets

#: Growth of sizes from band to band.
GROWTH = 1.7
#: Chance that a shingle of one set is in another of its band, for the cost of a chance agreement.
SHARED = 0.35
MOST_DELETIONS = 3
#: Segments beyond the pigeonhole's need, as a share of it.
SLACK = 0.1
#: Rows of a bucket that one task compares with the whole bucket; larger buckets are dealt to several tasks.
BUCKET_ROWS = 4000
#: 64-bit words of a parity sketch.
SKETCH = 16


@dataclass(frozen=True)
class Rule:
    """k words a shingle; a link needs den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    @property
    def j(self) -> float:
        return self.num / self.den

    def most_apart(self, s: int, t: int) -> int:
        """Largest difference of linked sets of these sizes."""
        return (self.den - self.num) * (s + t) // (self.den + self.num)

    def smallest(self, s: int) -> int:
        """Smallest size that can link with size s."""
        return -(-self.num * s // self.den)


def bands(limit: int = 1 << 31) -> list[int]:
    """First size of each band, from 1."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


EDGES = np.array(bands())


def allocate(rule: Rule, classes: dict[int, int]) -> list[tuple[int, int]]:
    """(segments, segments with deletions) of each band's scheme, by cost; classes: how many each band holds.

    Larger sets get SLACK more segments than the pigeonhole needs, so that each may leave its weakest out.
    """
    out = []
    for b in range(len(EDGES) - 1):
        top = int(EDGES[b + 1]) - 1
        # The larger set of a pair may lie in the next band.
        least = rule.most_apart(rule.den * top // rule.num, top) + 1
        n = classes.get(b, 0)
        best = None
        for d in range(0, min(MOST_DELETIONS, least // 2) + 1):
            plain = least - 2 * d + int(SLACK * least)
            m = plain + d
            length = top / m
            rows = n * (m + d * length)
            agree = n * n * plain * SHARED**length + n * n * d * (length + 1) * SHARED ** max(length - 1, 0)
            if best is None or rows + agree < best[0]:
                best = (rows + agree, m, d)
        out.append(best[1:])
    return out


def most_keys(rule: Rule, plan: list[tuple[int, int]], b: int) -> int:
    """Index keys that a set of band b has at most, on average over where its grams fall: those of all its schemes."""
    low = int(np.searchsorted(EDGES, max(1, rule.smallest(int(EDGES[b]))), "right")) - 1
    return sum(m + d * -(-int(EDGES[b + 1]) // m) for m, d in plan[low : b + 1])


def parts_for(keys: int, dealt: int) -> int:
    """Parts of an index of so many keys: as many as the session deals shuffles to, and more where a part would hold
    more than KEYS_A_PART. Their number fits 16 bits of a key's name; from 65,535 on parts grow instead."""
    return max(min(dealt, MOST_PARTS), min(-(-keys // KEYS_A_PART), MOST_PARTS))


def _segment_rows(grams: np.ndarray, salted: np.ndarray, band: int, m: int, d: int, least: int):
    """Index keys of one set under one scheme; bit 0 tells a deletion from a plain segment.

    least: differences, plus one, that must not hide every match. Segments with deletions count for two. Of the
    plain ones the largest are used, all down to the size t at which least - 2d are reached: segments that agree
    are of one size, so whichever of two sets has the larger t, a segment that it uses and that agrees is used by
    the other as well. Empty and tiny segments, which strangers share, are so left out unless they are needed.
    """
    cuts = np.searchsorted(grams, _cuts(m))
    run = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(salted, out=run[1:])
    bounds = np.concatenate([[0], cuts, [len(grams)]])
    total = run[bounds[1:]] - run[bounds[:-1]]
    place = _places(band, m)
    size = np.diff(bounds)
    want, plain = least - 2 * d, size[d:]
    use = np.ones(m, bool)
    if want <= 0:
        use[d:] = False
    elif want < len(plain):
        use[d:] = plain >= np.partition(plain, len(plain) - want)[len(plain) - want]
    keys = [mix(total[use] + place[use]) & ~np.uint64(1)]
    for i in range(d):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            keys.append(mix(total[i] - salted[a:b] + place[i]) | np.uint64(1))
    return np.concatenate(keys)


@functools.lru_cache(maxsize=256)
def _cuts(m: int) -> np.ndarray:
    """Where the segments' ranges begin, but for the first."""
    return np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)


@functools.lru_cache(maxsize=256)
def _places(band: int, m: int) -> np.ndarray:
    """A salt for each segment of a band's scheme. Even before the bit is set, so plain and deleted agree."""
    return mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 40))


def keys_of(grams: np.ndarray, rule: Rule, plan: list[tuple[int, int]]) -> np.ndarray:
    """All index keys of a set, one scheme or two."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    salted = mix(grams ^ np.uint64(0xD6E8FEB86659FD93))
    own = int(np.searchsorted(EDGES, n, "right")) - 1
    low = int(np.searchsorted(EDGES, max(1, rule.smallest(n)), "right")) - 1
    # Partners in its own scheme may be larger; in a lower one they are smaller, and of that band at most.
    least = lambda b: 1 + (rule.most_apart(rule.den * n // rule.num, n) if b == own else rule.most_apart(n, int(EDGES[b + 1]) - 1))
    return np.concatenate([_segment_rows(grams, salted, b, *plan[b], least(b)) for b in range(low, own + 1)])


def digest_of(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    a = mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(grams ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    x = mix(np.array([a + np.uint64(len(grams)), b], dtype=np.uint64)).view(np.int64)
    return int(x[0]), int(x[1])


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """Parity of the elements of each of SKETCH*64 cells. Differing cells never exceed the sets' difference."""
    cell = (grams % np.uint64(SKETCH * 64)).astype(np.int64)
    odd = np.bincount(cell, minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digests(batches, k: int):
    for batch in pieces(batches):
        n, c, c2, sketch = [], [], [], []
        for g in shingle_sets(batch.column("text"), k):
            d = digest_of(g)
            n.append(len(g)), c.append(d[0]), c2.append(d[1]), sketch.append(sketch_of(g).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, c, c2)], pa.array(sketch, pa.binary())], ["doc_id", "n", "c", "c2", "sketch"])


#: Index keys packed together, at least, before they are dealt out.
PACK = 1 << 18
#: Keys that go to a part from one piece, at least, so that a packed row's own columns weigh little.
KEYS_A_ROW = 64
#: Index keys of a part, some 100 bytes each while they are sorted, and the parts that there may be.
KEYS_A_PART, MOST_PARTS = 1 << 22, (1 << 16) - 1
PACKED = "part int, home int, sure boolean, keys binary, owners binary, classes binary"


def _pack(key: np.ndarray, c: np.ndarray, parts: int, turn: int):
    """Rows of PACKED for a piece of the index. Keys go to the part of their range, 6 bytes each; owners are 2-byte
    places in the row's classes, whose top bit says that the piece itself shares the key.

    Of a key that several classes of the piece share only one row, a plain one, goes to the key's part; the
    others are known to stay and are dealt out anywhere. So a key with a third of all documents reaches its part
    once a piece.
    """
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
    key, c = key[new], c[new]
    bare = key >> np.uint64(1)
    first = np.ones(len(key), bool)
    first[1:] = bare[1:] != bare[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate([at, [len(key)]]))
    shared = (size > 1) & (key[at] & np.uint64(1) == 0)
    known = np.repeat(shared, size)
    sure = known & ~first
    home = ((key >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
    for flag, pick in ((False, ~sure), (True, sure)):
        k, o, h, seen = key[pick], c[pick], home[pick], known[pick]
        bounds = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
        for i in range(len(bounds) - 1):
            for lo in range(bounds[i], bounds[i + 1], 1 << 14):
                part = slice(lo, min(lo + (1 << 14), bounds[i + 1]))
                classes, owner = np.unique(o[part], return_inverse=True)
                owner = owner.astype(np.uint16) | (seen[part].astype(np.uint16) << 15)
                low = np.ascontiguousarray(k[part]).view(np.uint8).reshape(-1, 8)[:, :6]
                yield int(h[lo]) if not flag else (turn + i) % parts, int(h[lo]), flag, low.tobytes(), owner.tobytes(), classes.tobytes()


def _packed(batches, rule: Rule, plan, clash: dict, parts: int):
    turn, keys, own, held = 0, [], [], 0
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]

    def flush():
        rows = list(zip(*_pack(np.concatenate(keys), np.concatenate(own), parts, turn), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    for batch in pieces(batches):
        for g in shingle_sets(batch.column("text"), rule.k):
            if not len(g):
                continue
            c, c2 = digest_of(g)
            part = keys_of(g, rule, plan)
            keys.append(part)
            own.append(np.full(len(part), c2 if c in clash else c, np.int64))
            held += len(part)
            if held >= max(PACK, KEYS_A_ROW * parts):
                yield flush()
                turn, keys, own, held = turn + 1, [], [], 0
    if keys:
        yield flush()


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, known) of a packed row; keys are their 6 bytes."""
    low = np.frombuffer(row["keys"], dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    owner = np.frombuffer(row["owners"], dtype=np.uint16)
    return wide.view(np.uint64)[:, 0], np.frombuffer(row["classes"], dtype=np.int64)[owner & np.uint16(0x7FFF)], owner >= 0x8000


INDEX = "key long, deleted boolean, c long"


def _index_batch(home: int, key: np.ndarray, c: np.ndarray):
    named = (key >> np.uint64(1)).astype(np.int64) + (home << 47)
    return pa.RecordBatch.from_arrays([pa.array(named), pa.array((key & np.uint64(1)).astype(bool)), pa.array(c)], ["key", "deleted", "c"])


def _shared_keys(batches):
    """Index rows of a part whose key two classes share, one of them plain; the others link nobody."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key, c, known = _unpack(row)
            if row["sure"]:
                yield _index_batch(row["home"], key, c)
            else:
                held.setdefault(row["home"], []).append((key, c, known))
    for home in list(held):
        key, c, known = (np.concatenate(x) for x in zip(*held.pop(home), strict=True))
        order = np.lexsort((c, key))
        key, c, known = key[order], c[order], known[order]
        bare = key >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
        size = np.diff(np.concatenate([at, [len(key)]]))
        group = np.repeat(np.arange(len(at)), size)
        several = np.logical_or.reduceat(c != c[at][group], at)
        stay = (several & (key[at] & np.uint64(1) == 0)) | np.logical_or.reduceat(known, at)
        yield _index_batch(home, key[stay[group]], c[stay[group]])


def _texts(batches, k: int, clash: dict):
    """(c, text) of all rows, or with a column want of those whose set has the class wanted."""
    for batch in pieces(batches):
        c = []
        for g in shingle_sets(batch.column("text"), k):
            d = digest_of(g)
            c.append(d[1] if d[0] in clash else d[0])
        got = np.array(c, dtype=np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(got), batch.column("text")], ["c", "text"])
        yield out.filter(pa.array(got == np.asarray(batch.column("want")))) if "want" in batch.schema.names else out


def _verify(batches, rule: Rule):
    """Pairs (a, b, text_a, text_b): those that link."""
    for batch in pieces(batches, "text_a"):
        good = np.zeros(batch.num_rows, bool)
        left, right = shingle_sets(batch.column("text_a"), rule.k), shingle_sets(batch.column("text_b"), rule.k)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = both and rule.den * both >= rule.num * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def components(tmp: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(c, comp): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps, each one grouped minimum, until no edge changes: rounds grow
    with the logarithm of a component's length, and no task holds a component.
    """
    def kept(df) -> tuple[DataFrame, tuple]:
        """The edges saved, and what tells two edge sets apart; both from one job."""
        seen = Observation()
        out = tmp.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")), "edges")
        return out, tuple(seen.get[k] for k in ("n", "x", "s"))

    now, seen = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: each larger neighbour goes to the smallest around u.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: all smaller neighbours of u, and u, go to the smallest of them.
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, last = seen, now
        now, seen = kept(small)
        tmp.drop(last)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("c"), F.col("v").alias("comp"))


def link_classes(docs: DataFrame, rule: Rule, tmp: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """(documents: doc_id, n, c; components: c, comp of classes in links; the digests told apart by the second).

    c is a document's class of equal sets.
    """
    spark = docs.sparkSession
    rows = need(docs, doc_id="long", text="string")
    first = tmp.save(rows.mapInArrow(functools.partial(_digests, k=rule.k), "doc_id long, n long, c long, c2 long, sketch binary"), "digests")
    # Different sets with one 64-bit digest: told apart by the second. Expected: none, up to billions of sets.
    clashing = first.filter("n > 0").groupBy("c").agg(F.min("c2").alias("x"), F.max("c2").alias("y")).filter("x <> y").select("c").limit(100_001).collect()
    if len(clashing) > 100_000:
        raise RuntimeError("digest clashes beyond their bound")
    clash = {r["c"]: True for r in clashing}
    told = F.when(F.col("c").isin(list(clash)), F.col("c2")).otherwise(F.col("c")) if clash else F.col("c")
    known = tmp.save(first.select("doc_id", "n", told.alias("c")), "known")
    classes = tmp.save(first.filter("n > 0").groupBy(told.alias("c")).agg(F.min("n").alias("n"), F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"), F.count("*").alias("docs")), "classes")
    tmp.drop(first)
    edges = [int(e) for e in EDGES]
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("n"))) - 1
    counted = classes.groupBy("n").agg(F.count("*").alias("m"), F.sum("docs").alias("docs")).groupBy(band.alias("b")).agg(F.sum("m").alias("m"), F.sum("docs").alias("docs")).collect()
    plan = allocate(rule, {r["b"]: r["m"] for r in counted})

    parts = parts_for(sum(r["docs"] * most_keys(rule, plan, r["b"]) for r in counted), int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.filter(F.col("text").isNotNull()).mapInArrow(functools.partial(_packed, rule=rule, plan=plan, clash=clash, parts=parts), PACKED)
    index = tmp.save(packed.repartitionById(parts, "part").mapInArrow(_shared_keys, INDEX).distinct(), "index")

    # The most connected class of each bucket: largest sum of its buckets' sizes.
    size = index.groupBy("key").agg(F.count("*").alias("s"))
    weight = index.join(size, "key").groupBy("c").agg(F.sum("s").alias("w"))
    best = index.join(weight, "c").groupBy("key").agg(F.max(F.struct("w", "c")).alias("top")).select("key", F.col("top.c").alias("hub"))
    tried = index.join(best, "key").filter("c <> hub").select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    pairs1 = tmp.save(_near(classes, tried, rule), "pairs")
    texts1 = _fetch(tmp, rows, classes, pairs1, rule, clash)
    links1 = tmp.save(_verified(texts1, pairs1, rule), "links")
    tmp.drop(texts1)
    comp1 = components(tmp, links1)

    # What is still apart in a bucket: pairs of different components, one of the two plain.
    labelled = index.join(comp1, "c", "left").select("key", "deleted", "c", F.coalesce("comp", "c").alias("comp"))
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts")).filter("x <> y").select("key", "parts")
    left_over = labelled.join(open_keys, "key").join(classes.select("c", "n", *_words_of_sketch("s")), "c")
    left_over = tmp.save(left_over, "open")
    # A large bucket's rows are dealt out on one side, and each part meets all of it on the other.
    dealt = {"a": F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    side = lambda t: left_over.select(F.col("key").alias("k" + t), dealt[t].alias("p" + t), F.col("deleted").alias("d" + t), F.col("c").alias(t), F.col("comp").alias("c" + t), F.col("n").alias("n" + t), *[F.col(f"s{i}").alias(f"s{t}{i}") for i in range(SKETCH)])
    met = (F.col("ka") == F.col("kb")) & (F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~(F.col("da") & F.col("db")) & _may_link(rule)
    pairs2 = tmp.save(side("a").join(side("b"), met).select("a", "b").distinct().join(pairs1, ["a", "b"], "left_anti"), "pairs")
    tmp.drop(index, left_over)
    texts2 = _fetch(tmp, rows, classes, pairs2, rule, clash)
    links2 = tmp.save(_verified(texts2, pairs2, rule), "links")
    tmp.drop(texts2)
    out = components(tmp, comp1.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionByName(links2))
    tmp.drop(pairs1, pairs2, links1, links2, classes)
    return known, out, clash


def _words_of_sketch(name: str):
    """The sketch's 64-bit words as columns."""
    return [F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"{name}{i}") for i in range(SKETCH)]


def _may_link(rule: Rule):
    """Sizes near enough and parity sketches no further apart than linked sets can be."""
    apart = sum(F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(SKETCH))
    lo, hi = F.least("na", "nb"), F.greatest("na", "nb")
    return (lo * rule.den >= hi * rule.num) & (apart * (rule.den + rule.num) <= (rule.den - rule.num) * (F.col("na") + F.col("nb")))


def _near(classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    side = lambda t: classes.select(F.col("c").alias(t), F.col("n").alias("n" + t), *_words_of_sketch("s" + t))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_link(rule)).select("a", "b")


#: Spark puts a Bloom filter of the wanted ids before the shuffle of the texts from this size of the table on.
BLOOM_FROM = "1MB"


def _fetch(tmp: Scratch, rows: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule, clash: dict) -> DataFrame:
    """(c, text), one text for each class in pairs, from the documents with the class's smallest doc_id."""
    spark = tmp.spark
    conf = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(conf)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    named = tmp.save(classes.select("c", "id").join(wanted, "c", "left_semi").select(F.col("c").alias("want"), "id"), "wanted")
    try:
        spark.conf.set(conf, BLOOM_FROM)
        # The comparison holds for every id; it marks this side as the one to filter the other by.
        with_id = rows.join(named.filter(F.col("id") >= F.lit(-(1 << 63))), F.col("doc_id") == F.col("id")).select("text", "want")
        found = with_id.mapInArrow(functools.partial(_texts, k=rule.k, clash=clash), "c long, text string")
        nameless = rows.filter("doc_id is null").select("text").mapInArrow(functools.partial(_texts, k=rule.k, clash=clash), "c long, text string")
        nameless = nameless.join(named.filter("id is null").select(F.col("want").alias("c")), "c", "left_semi")
        return tmp.save(found.unionByName(nameless).groupBy("c").agg(F.first("text").alias("text")), "texts")
    finally:
        spark.conf.set(conf, before)


def _verified(texts: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    both = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(functools.partial(_verify, rule=rule), "a long, b long")


def link_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id: the smallest doc_id reachable by links, a document's own included. Null and empty texts have
    no shingles and link with nothing. Null ids are never a component's id unless it has no other. Repeated
    rows and copies are one class and get a row each. Rows of one doc_id with different texts are different
    documents that share a name. Other columns are ignored; an empty table gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "jaccard")
    named, comps, _ = link_classes(docs, rule, tmp)
    least = named.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("id")).join(comps, "c", "left").select("c", F.coalesce("comp", "c").alias("comp"), "id")
    root = least.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = least.select("c", "comp").join(root, "comp").select("c", "component_id")
    empty = named.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.filter("n > 0").join(of_class, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def _with_class(batches, k: int, clash: dict, text: str, name: str):
    """The rows with the class of their text in a further column, null without shingles; the text column goes."""
    for batch in pieces(batches, text):
        c = []
        for g in shingle_sets(batch.column(text), k):
            d = digest_of(g)
            c.append((d[1] if d[0] in clash else d[0]) if len(g) else None)
        yield batch.drop_columns([text]).append_column(name, pa.array(c, pa.int64()))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs with one document of each group of linked ones, the one with the smallest doc_id, all columns kept.

    A document is an id and a set of shingles: rows of one id with different sets are judged apart, and of those
    linked under the smallest id one set stays. Documents without shingles stay, and so do repeated rows of the
    document that stays. Needs doc_id to be an integer; a null doc_id counts as an id after all others, so such
    rows stay only if their group has no other.
    """
    tmp = Scratch(docs.sparkSession, "keep")
    named, comps, clash = link_classes(docs, rule, tmp)
    # The first of each class, then of each component: classes, and not their copies, meet their component.
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "c")
    leaders = named.filter("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")).alias("f")).select("c", "f.doc_id").join(comps, "c", "left")
    first = leaders.groupBy(F.coalesce("comp", "c").alias("comp")).agg(F.min(order).alias("first"))
    name, text, spread, kept_id, kept_class, stays = (fresh(docs, n) for n in ("__c", "__text", "__spread", "__kept", "__class", "__stays"))
    keepers = first.select(F.col("first.doc_id").alias(kept_id), F.col("first.c").alias(kept_class), F.lit(True).alias(stays))
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    told = docs.withColumn(text, F.col("text").cast("string")).mapInArrow(functools.partial(_with_class, k=rule.k, clash=clash, text=text, name=name), schema)
    # Rows without shingles meet no keeper; a number of their own spreads them.
    told = told.withColumn(spread, F.coalesce(F.col(name), F.monotonically_increasing_id()))
    met = (F.col(spread) == F.col(kept_class)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & F.col(name).isNotNull()
    return told.join(keepers, met, "left").filter(F.col(name).isNull() | F.col(stays)).select(*[F.col(f"`{c}`") for c in docs.columns])
