"""Text operators of ingestion and question answering: chunks, extraction filters, excerpts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MAX_CHARS, OVERLAP = 300, 40
_BLANK_LINE = re.compile(r"\n\s*\n")


def chunks_of(body: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed greedily to at most `most` characters, long ones cut; each chunk but the first opens
    with the stripped last characters of the one before."""
    if most <= 0:
        raise ValueError("chunks need a positive size")
    pieces: list[tuple[str, bool]] = []
    for p in filter(None, map(str.strip, _BLANK_LINE.split(body.strip()))):
        if len(p) <= most:
            pieces.append((p, True))
        else:
            pieces += [(cut, False) for i in range(0, len(p), most) if (cut := p[i : i + most].strip())]
    packed: list[str] = []
    joinable = False
    for piece, whole in pieces:
        if whole and joinable and len(packed[-1]) + 2 + len(piece) <= most:
            packed[-1] += "\n\n" + piece
        else:
            packed.append(piece)
        joinable = whole
    keep = min(max(overlap, 0), most // 2)
    tails = [c[-keep:].strip() if keep else "" for c in packed]
    return [f"{tail}\n\n{c}" if tail else c for tail, c in zip(["", *tails], packed, strict=False)]


def _chunk(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chunks_of(x) if isinstance(x, str) else [])


def chunk(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk of every document; blank and null texts have none."""
    return docs.select("doc_id", F.posexplode(F.pandas_udf(_chunk, "array<string>")(F.col(column))).alias("chunk_index", "chunk"))


# Fixed values of the extraction filters.
BRIDGES = ["주체", "subject", "entity", "normalized", "normalized_as", "canonical", "canonical_form"]
KEY_VALUE = ["값", "value", "has_value", "label_value"]
COPULAS = ["입니다", "이다", "임", "있습니다", "없습니다", "합니다"]
TYPED_FUNCTORS = ["amount", "date", "number", "ordinal"]
UNITS_ALONE = ["%", "％", "건", "개", "곳", "명", "년", "원", "조", "억", "만"]
ROLE_RELATIONS = ["역할", "직책", "직위", "직함", "대표", "대표이사", "role", "title", "position"]
ROLE_CUES = ["원문:", "대표", "대표이사", "CTO", "CEO", "CFO", "담당자", "발표자", "총괄", "소속"]
#: A measure: a digit of any script, perhaps commas and blanks, then a unit.
METRIC = r"\p{Nd},*\s*(?:" + "|".join(UNITS_ALONE) + ")"
RECORD_END = r"[\n\r]+|[。.!?;；]"
PLACEHOLDER_LABELS = ["column", "field", "metadata", "row", "source", "value"]
HANGUL, HAN, ASCII_LABEL = r"[가-힣]", r"[㐀-䶿一-鿿豈-﫿]+", r"^[A-Za-z0-9_ -]+$"


def extraction_filters(items: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """items with rewritten relation and dropped: the first filter that refuses an item, null for those that stay.

    items: batch, subject, subject_kind, relation, relation_kind, object, object_kind, source_text; canonical is
    added by the caller's alias join. Filters, in order: bad_shape, bridge, reversed_role, unbacked_han,
    unbacked_ascii, unsupported_metric. Role bearers are found per batch by one semi-join.
    """
    typed_call = lambda c: (F.col(f"{c}_kind") == "term") & F.rlike(c, F.lit(r"^\s*(?:" + "|".join(TYPED_FUNCTORS) + r")\("))
    plain = lambda c: F.col(f"{c}_kind") == "string"
    rel, obj = F.trim("relation"), F.trim("object")
    shape = typed_call("subject") | typed_call("relation") | (plain("object") & (obj.isin(*COPULAS) | obj.isin(*UNITS_ALONE))) | (plain("relation") & F.endswith(text.compact(F.col("relation")), F.lit("여부")))
    is_role = plain("relation") & F.lower(F.trim("canonical")).isin(*ROLE_RELATIONS)
    bearers = items.filter(is_role & plain("subject")).select("batch", F.trim("subject").alias("__bearer")).distinct().withColumn("__reversed", F.lit(True))
    at = items.withColumn("__shape", shape).withColumn("__role", is_role).withColumn("__obj", obj)
    at = at.join(bearers.withColumnRenamed("batch", "__batch"), (F.col("batch") == F.col("__batch")) & F.col("__role") & plain("object") & (F.col("__obj") == F.col("__bearer")), "left")
    korean = F.rlike("source_text", F.lit(HANGUL))
    foreign = lambda c: F.exists(F.regexp_extract_all(c, F.lit(HAN), F.lit(0)), lambda h: ~F.contains(F.col("source_text"), h))
    han = korean & (foreign(F.col("subject")) | foreign(F.col("canonical")) | foreign(F.col("object")))
    known = sorted({"value", *[c.lower() for c in aliases.values()]})
    packed = at.withColumn("__text", text.compact(F.col("source_text"))).withColumn("__rel", text.compact(F.col("canonical"))).withColumn("__subject", text.compact(F.col("subject")))
    # A measure's records: those of the source that hold its object, or else its relation.
    packed = packed.withColumn("__object", text.compact(F.col("object"))).withColumn("__label", text.compact(F.col("relation"))).withColumn("__records", text.compact_all(F.split("source_text", RECORD_END)))
    ascii_rel = korean & ~F.lower("canonical").isin(*known) & F.rlike("canonical", F.lit(ASCII_LABEL)) & ~F.contains("__text", F.col("__rel"))
    holds = lambda rec, c: (F.col(c) != "") & F.contains(rec, F.col(c))
    backed = F.exists("__records", lambda rec: (holds(rec, "__object") | holds(rec, "__label")) & F.contains(rec, F.col("__subject")))
    metric = F.rlike("object", F.lit(METRIC)) & ((F.col("__subject") == "") | ~backed)
    bridge = plain("relation") & F.lower("canonical").isin(*BRIDGES) & ((F.col("subject_kind") == "term") | (F.col("object_kind") == "term"))
    dropped = (
        F.when(F.col("__shape"), "bad_shape").when(bridge, "bridge").when(F.col("__reversed"), "reversed_role").when(han, "unbacked_han").when(ascii_rel, "unbacked_ascii").when(metric, "unsupported_metric")
    )
    out = packed.withColumn("dropped", dropped).withColumn("relation", F.when(plain("relation") & rel.isin(*KEY_VALUE), "value").otherwise(F.col("relation")))
    return out.drop("__shape", "__role", "__obj", "__batch", "__bearer", "__reversed", "__text", "__rel", "__subject", "__object", "__label", "__records")


def low_signal(label: str = "relation"):
    """Whether a relation label says too little to be shown as a discovery: null, blank or a placeholder."""
    name = F.lower(F.trim(text.nfc(F.col(label))))
    return F.coalesce((name == "") | name.isin(*PLACEHOLDER_LABELS), F.lit(True))


def renamed(facts: DataFrame) -> DataFrame:
    """Facts whose relation an alias renamed."""
    return facts.filter(F.col("relation") != F.col("canonical"))


def needs_role_pass(column: str = "text"):
    """Whether a chunk names roles, and so gets a second extraction pass for them."""
    cue = F.lit(False)
    for c in ROLE_CUES:
        cue = cue | F.contains(F.col(column), F.lit(c))
    return F.coalesce(cue, F.lit(False))


TOKEN = re.compile(r"[A-Za-z0-9_]{2,}|[㐀-鿿豈-﫿가-힣]+")
NEAR, BEFORE, AFTER, MOST_EXCERPTS = 300, 240, 420, 8


def question_tokens(question: str) -> list[str]:
    return list(dict.fromkeys(unicodedata.normalize("NFC", m).casefold() for m in TOKEN.findall(question)))


def best_excerpt(body: str, tokens: list[str]) -> tuple[str, int]:
    """(excerpt, score): around the first hit of the token that has most tokens near it; the earliest token on ties."""
    folded = unicodedata.normalize("NFC", body).casefold()
    hits = [(folded.find(t), t) for t in tokens]
    scored = [(sum(u in folded[max(0, at - NEAR) : at + NEAR] for u in tokens), -i, at) for i, (at, _) in enumerate(hits) if at >= 0]
    if not scored:
        return "", 0
    score, _, at = max(scored)
    start, end = max(0, at - BEFORE), min(len(body), at + AFTER)
    return ("..." if start else "") + " ".join(body[start:end].split()) + ("..." if end < len(body) else ""), score


def excerpt_search(docs: DataFrame, question: str, top: int = MOST_EXCERPTS) -> DataFrame:
    """The best excerpts for a question: score, doc_id, excerpt; by score, then id. top is the report's size."""
    tokens = question_tokens(question)

    def find(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_excerpt(x, tokens) if isinstance(x, str) else ("", 0) for x in s], columns=["excerpt", "score"])

    # Only texts that may hold a token reach Python: ASCII ones by lower(), which folds them; others in any case,
    # as letters such as the sharp s fold to others.
    hit = F.rlike("text", F.lit(r"[^\x00-\x7F]"))
    for t in tokens:
        hit = hit | F.contains(F.lower("text"), F.lit(t))
    found = docs.filter(hit).select("doc_id", F.pandas_udf(find, "excerpt string, score long")("text").alias("e"))
    return found.select("doc_id", "e.score", "e.excerpt").filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(top)


def mentioned_facts(facts: DataFrame, question: str, top: int = 8) -> DataFrame:
    """Facts whose subject or object occurs in the question, the oldest first; top is the report's size."""
    q = F.lit(unicodedata.normalize("NFC", question).casefold())
    folded = lambda c: F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), text.fold(F.col(c))).otherwise(F.lower(c))
    named = lambda c: F.contains(q, folded(c)) & (F.length(c) > 0)
    return facts.filter(named("subject") | named("object")).orderBy("id").limit(top)
