r"""Secret scans with Spark expressions only.

Base kinds are regex matches (assign, access, hex). The method adds kind entropy: candidate strings are runs of
20 or more key characters; a window of 20 slides over each, the counts of its characters are updated by the one
that leaves and the one that enters, and with them the sum of c*log2(c), from which the window's Shannon entropy
follows. A candidate whose best window passes its character class's threshold is a span, unless an allow-list
rule fits it or a base span holds it. A prefix such as `ghp_` is set aside before a candidate gets its class. The
thresholds of the classes leave out about 1 % of uniformly random windows; words reach them too, so they hold only
where letters and digits alternate as in random keys, and KEY_BITS, which words hardly reach, holds for every
candidate. Keys of fewer than 20 characters, of digits only or of letters of one case only can't be told from
words and numbers this way: only base kinds find them.

Positions come from Spark's own functions: split gives the gaps between matches, regexp_extract_all the matches;
running sums of their lengths are the starts and ends in code points. No pattern repeats a group but possessively,
as the JVM matches other repeated groups by recursion, whose depth grows with the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, need, running_sums

# Fixed values of the task's contract.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_ASSIGN, MIN_ACCESS = 12, 18

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+"
#: A maker's prefix: short words of letters, each ended by a mark.
PREFIX = r"^(?:[A-Za-z]{2,10}[_-]){1,3}+"
#: Bits a character that a window must reach whatever the candidate's class.
KEY_BITS = 4.05
#: The same by class where the candidate alternates: class, bits, least alternations. The first class that fits counts.
#: Bits are the lowest hundredth of windows of 20 random characters (of the class's smallest usual alphabet).
CLASSES = [
    (r"^[0-9a-fA-F]+$", 2.85, 0),
    (r"^[A-Z2-7=-]+$", 3.30, 2),
    (r"^(?:[0-9A-Z+/_=.-]+|[0-9a-z+/_=.-]+)$", 3.40, 3),
    (r"^[A-Za-z]+$", 3.55, 0),
    (r"^", 3.63, 4),
]
#: A change of kind (lower case, upper case, digit) between neighbours, but for a capital before small letters. A
#: candidate needs one for each SPARSE characters at least, besides its class's number; random keys have 3 to 8 a 20.
CHANGE, SPARSE = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Candidates that are no secrets. Each rule: patterns that must all be found, and patterns that must not be.
ALLOWED = [
    # Joined words in capitals and small letters.
    ([r"^(?:[A-Z]++|[a-z]*+(?:[A-Z]{1,6}[a-z]{2,}+|[A-Z][a-z](?=[A-Z][a-z]|$))*+[A-Z]{0,6})$"], []),
    # Words of at most 18 letters between marks, as in paths and dashed names.
    ([r"^[A-Za-z._/=-]+$", r"[._/=-][A-Za-z]"], [r"[A-Za-z]{19}"]),
    # Numbers, dates and rules.
    ([r"^[0-9._/=+-]+$"], []),
    # UUIDs.
    ([r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"], []),
    # Samples and addresses.
    ([r"(?i)example|sample|placeholder|lorem|www\."], []),
]
#: Counters of five bits, twelve in a number: the counts of a window of 20 characters out of the alphabet.
BITS, PER_WORD = 5, 12
WORDS = -(-(len(ALPHABET) + 1) // PER_WORD)


def _spans(text: Column, pattern: str, kind: str, keep=None, groups: bool = False) -> Column:
    """array<struct<start, rank, end, kind>> of the matches of pattern that keep() holds for."""
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if groups else found
    # The text before the k-th match holds k gaps and the matches before it.
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("match"), value.alias("value"))

    def placed(p):
        ends = running_sums(F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))))
        rows = F.arrays_zip(ends.alias("end"), p.alias("p"))
        kept = F.filter(rows, lambda r: r["p"]["match"].isNotNull() & (keep(r["p"]["value"]) if keep else F.lit(True)))
        return F.transform(kept, lambda r: F.struct((r["end"] - F.length(r["p"]["match"])).alias("start"), F.lit(rank).alias("rank"), r["end"].alias("end"), F.lit(kind).alias("kind")))

    return bound(parts, placed)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of a string; by incremental counts.

    The counts are small numbers packed into a few longs, so a step touches the counters of the two characters
    that enter and leave alone. A string shorter than the window has none: 0.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    unit = F.array(*[F.lit(1 << BITS * (c % PER_WORD)).cast("long") for c in range(len(ALPHABET) + 1)])
    chars = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    f = lambda c: F.get(table, c.cast("int"))
    names = [f"w{i}" for i in range(WORDS)]
    word = lambda acc, c: F.get(F.array(*[acc[n] for n in names]), F.floor(c / PER_WORD).cast("int"))
    count = lambda acc, c: F.call_function("shiftright", word(acc, c), (c % PER_WORD * BITS).cast("int")) % (1 << BITS)

    def moved(acc, c, by):
        step = F.coalesce(F.get(unit, c), F.lit(0).cast("long")) * by
        return [(acc[n] + F.when(F.floor(c / PER_WORD) == i, step).otherwise(0)).alias(n) for i, n in enumerate(names)]

    def enter(acc, p):
        """The character that comes is counted."""
        k = count(acc, p["came"])
        return F.struct(*moved(acc, p["came"], 1), (acc["sum"] + f(k + 1) - f(k)).alias("sum"), (acc["seen"] + 1).alias("seen"), acc["best"].alias("best"))

    def leave(acc, p):
        """The one that goes is counted off; then the window stands."""
        gone = p["went"].isNotNull()
        k = F.when(gone, count(acc, p["went"]))
        total = acc["sum"] + F.when(gone, f(k - 1) - f(k)).otherwise(0.0)
        return F.struct(*moved(acc, p["went"], -1), total.alias("sum"), acc["seen"].alias("seen"), acc["best"].alias("best"))

    def judge(acc):
        bits = F.lit(math.log2(window)) - acc["sum"] / F.lit(float(window))
        best = F.when(acc["seen"] >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"])
        return F.struct(*[acc[n].alias(n) for n in names], acc["sum"].alias("sum"), acc["seen"].alias("seen"), best.alias("best"))

    step = lambda acc, p: bound(bound(enter(acc, p), lambda a: leave(a, p)), judge)
    lagged = F.concat(F.array_repeat(F.lit(None).cast("int"), window), chars)
    pairs = F.filter(F.arrays_zip(chars.alias("came"), lagged.alias("went")), lambda p: p["came"].isNotNull())
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def _allowed(value: Column) -> Column:
    allowed = F.lit(False)
    for found, lacking in ALLOWED:
        fits = F.lit(True)
        for p in found:
            fits = fits & F.rlike(value, F.lit(p))
        for p in lacking:
            fits = fits & ~F.rlike(value, F.lit(p))
        allowed = allowed | fits
    return allowed


def _is_secret(value: Column) -> Column:
    def judged(core):
        changes = F.regexp_count(core, F.lit(CHANGE))
        bits = F.lit(KEY_BITS)
        for pattern, least, often in reversed(CLASSES):
            enough = changes >= F.greatest(F.lit(float(often)), F.length(core) / SPARSE) if often else F.lit(True)
            bits = F.when(F.rlike(core, F.lit(pattern)), F.when(enough, least).otherwise(KEY_BITS)).otherwise(bits)
        return F.when(_allowed(value) | _allowed(core), F.lit(False)).otherwise(window_entropy(core) >= bits)

    bare = F.regexp_replace(value, PREFIX, "")
    return bound(F.when(F.length(bare) >= WINDOW, bare).otherwise(value), judged)


def scan_secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns named in keep, and spans array<struct<start, rank, end, kind>> of every document.

    spans sort by start, then kind in the order of KINDS. Null and empty texts have none. Repeated rows give
    repeated rows; columns not named are ignored; an empty table gives no rows. No shuffle: each row is judged
    alone, and a regex cheaper than any span gates the work on a text without secrets.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gated = lambda cond, spans: F.when(cond, spans).otherwise(none)
    kept = ["doc_id", *[c for c in keep if c != "doc_id"]]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("__t"))
    base = rows.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        gated(F.rlike("__t", F.lit(ASSIGN)), _spans(F.col("__t"), ASSIGN, "assign", lambda v: F.length(v) >= MIN_ASSIGN, groups=True)).alias("__assign"),
        gated(F.contains("__t", F.lit("AKIA")), _spans(F.col("__t"), ACCESS, "access", lambda v: F.length(v) >= MIN_ACCESS)).alias("__access"),
        gated(F.rlike("__t", F.lit(HEX)), _spans(F.col("__t"), HEX, "hex")).alias("__hex"),
        gated(F.rlike("__t", F.lit(CANDIDATE)), _spans(F.col("__t"), CANDIDATE, "entropy", _is_secret)).alias("__more"),
    )
    known = F.concat("__assign", "__access", "__hex")
    fresh = F.filter("__more", lambda m: ~F.exists(known, lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return base.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(known, fresh)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by a mark of its kind; of overlapping spans the first counts."""
    t = F.coalesce(text, F.lit(""))
    piece = lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint,kind:string>>)")
    # The pieces that stay, each with the kind of the span behind it; spans that begin inside one before fall away.
    cuts = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("cuts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["cuts"].alias("cuts"))).otherwise(
            F.struct(s["end"].alias("at"), F.array_append(acc["cuts"], F.struct(acc["at"].alias("a"), s["start"].alias("b"), s["kind"].alias("kind"))).alias("cuts"))
        ),
    )
    tail = lambda at: F.substring(t, (at + 1).cast("int"), F.greatest(F.length(t) - at, F.lit(0)).cast("int"))
    marked = lambda c: F.concat(piece(c["a"], c["b"]), F.lit("[SECRET:"), c["kind"], F.lit("]"))
    done = bound(cuts, lambda c: F.concat(F.array_join(F.transform(c["cuts"], marked), ""), tail(c["at"])))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with all columns, the secrets in text replaced by marks and n_chars, where there is one, counted anew.

    Texts without secrets, null ones included, stay as they are, n_chars with them.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = scan_secrets(packed, "row")
    field = lambda c: F.col("row").getField(c)
    changed = marked.withColumn("clean", redact(field("text").cast("string"), F.col("spans")))
    size = lambda c: F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(field(c))
    return changed.select(*[(F.col("clean") if c == "text" else size(c) if c == "n_chars" else field(c)).alias(c) for c in docs.columns])


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of op5, from scan_secrets."""
    found = scan_secrets(need(docs, doc_id="long", text="string"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
