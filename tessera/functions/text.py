"""Unicode text functions that Spark lacks, and term columns. All are Arrow UDFs with a native path for ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import terms

_SEPARATORS = re.compile(r"[\s\W_]+")


def _each(f):
    """An Arrow UDF over strings that keeps nulls."""
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), StringType())


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(terms.nfc, na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Collations are no substitute: they equate more than NFC does."""
    wide = F.rlike(c, F.lit(r"[^\x00-\x7F]"))
    return F.when(wide, F.pandas_udf(_nfc, StringType())(F.when(wide, c))).otherwise(c)


def fold(c: Column) -> Column:
    """NFC, then case-folded: also where lower() leaves a letter alone, as with sharp s."""
    return _each(lambda x: unicodedata.normalize("NFC", x).casefold())(c)


def compact(c: Column) -> Column:
    """NFKC without white space, marks and underscores, case-folded."""
    return _each(lambda x: _SEPARATORS.sub("", unicodedata.normalize("NFKC", x)).casefold())(c)


def compact_all(c: Column) -> Column:
    """compact() of every text of an array."""
    one = lambda x: _SEPARATORS.sub("", unicodedata.normalize("NFKC", x)).casefold()
    return F.pandas_udf(lambda s: s.map(lambda xs: [one(x) for x in xs], na_action="ignore"), "array<string>")(c)


#: Characters that escape() does not write by a short sign: controls, line and paragraph separators, bidi marks.
_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u2028\u2029\u202A-\u202E\u2066-\u2069]"


def escape(c: Column) -> Column:
    """Line makers, control characters and bidi marks as escapes. Python sees only texts with a rare one of these."""
    odd, plain = F.rlike(c, F.lit(_ODD)), c
    for sign, shown in terms.SHOWN.items():
        plain = F.replace(plain, F.lit(sign), F.lit(shown))
    return F.when(odd, _each(terms.escape)(F.when(odd, c))).otherwise(plain)


def _term_fields(kind: pd.Series, value: pd.Series) -> pd.DataFrame:
    rows = []
    for k, v in zip(kind, value, strict=True):
        try:
            t = terms.parse(v) if k == "term" else terms.Str(terms.nfc(v))
            rows.append((terms.to_json(t), terms.key(t), None) if terms.is_ground(t) else (None, None, "term has variables"))
        except (terms.TermError, TypeError, AttributeError) as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["v", "cmp", "error"])


def slot(kind: Column, value: Column) -> Column:
    """struct<v, cmp, error> of a slot: kind term is parsed, kind string is a string term."""
    return F.pandas_udf(_term_fields, "v string, cmp string, error string")(kind, value)


def string_term(c: Column) -> Column:
    """struct<v, cmp> of a plain label that is printable ASCII without quotes or backslashes; native."""
    return F.struct(F.concat(F.lit('{"t":"string","v":"'), c, F.lit('"}')).alias("v"), F.concat(F.lit("s:"), c).alias("cmp"))


def render(c: Column, how: str = "shown") -> Column:
    """Display text of stored terms: surface, shown, answer or render."""
    f = getattr(terms, how)
    return _each(lambda x: f(terms.from_json(x)))(c)


def join_columns(values: Column) -> Column:
    """Several columns as one text: blanks inside a value are escaped, values joined by blanks; one stays raw."""
    spaced = F.array_join(F.transform(values, lambda x: F.replace(x, F.lit(" "), F.lit("\\ "))), " ")
    return F.when(F.size(values) == 1, values[0]).otherwise(spaced)


def sanitize(c: Column) -> Column:
    """struct<text, nulls>: NUL characters replaced by U+FFFD, and how many there were."""
    nul = F.lit("\u0000")
    return F.struct(F.replace(c, nul, F.lit("�")).alias("text"), F.coalesce(F.length(c) - F.length(F.replace(c, nul, F.lit(""))), F.lit(0)).alias("nulls"))


# Roles that fused Korean text joins to a name, longer ones first, and the length of such names.
ROLES = ["대표이사", "대표", "CTO", "CEO", "CFO", "담당자", "발표자", "총괄"]
SHORTEST, LONGEST = 2, 5


def _syllables(text: str, at: int, step: int) -> int:
    """How many of LONGEST characters from at on, forward or back, are Hangul syllables, up to the first that isn't."""
    n = 0
    while n < LONGEST and 0 <= at < len(text) and "가" <= text[at] <= "힣":
        n, at = n + 1, at + step
    return n


def split_fused(text: str) -> str:
    """A name fused with the role behind or before it gets a blank between, with the original in brackets."""
    out, at, kept = [], 0, 0
    while at < len(text):
        role = next((r for r in ROLES if text.startswith(r, at)), None)
        end = at + len(role) if role else at
        before = min(_syllables(text, at - 1, -1), at - kept) if role else 0
        after = _syllables(text, end, 1) if role else 0
        if role and before >= SHORTEST and not after:
            out += [text[kept : at - before], f"{text[at - before : at]} {role} (원문: {text[at - before : end]})"]
            at = kept = end
        elif role and after >= SHORTEST and not _syllables(text, at - 1, -1):
            out += [text[kept:at], f"{role} {text[end : end + after]} (원문: {text[at : end + after]})"]
            at = kept = end + after
        else:
            at += 1
    return "".join(out) + text[kept:]


def split_roles(c: Column) -> Column:
    """Separates fused name and role, keeping the original in brackets; texts without a role stay as they are."""
    held = F.lit(False)
    for role in ROLES:
        held = held | F.contains(c, F.lit(role))
    return F.when(held, _each(split_fused)(c)).otherwise(c)
