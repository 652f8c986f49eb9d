"""Whether an answer states another unit than its question asks in. The common forms: counters after 몇 or how many,
quantities with ASCII digits. Dates are no durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units by canonical name, the quantity each measures, and what may follow a unit.
SPELLINGS = {
    "YEAR": ["년", "연", "살", "세", "year", "years"], "MONTH": ["개월", "달", "month", "months"], "WEEK": ["주", "주일", "week", "weeks"], "DAY": ["일", "day", "days"],
    "HOUR": ["시간", "hour", "hours"], "MINUTE": ["분", "minute", "minutes"], "SECOND": ["초", "second", "seconds"], "PERCENT": ["퍼센트", "프로", "%", "percent"], "TIMES": ["배"],
    "KRW": ["원", "won"], "USD": ["달러", "dollar", "dollars"], "JPY": ["엔", "yen"], "EUR": ["유로", "euro"],
}
FAMILIES = {"time": ["YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND"], "ratio": ["PERCENT", "TIMES"], "money": ["KRW", "USD", "JPY", "EUR"]}
SUFFIXES = ["간", "가량", "정도", "쯤", "짜리"]

UNIT = {s: name for name, group in SPELLINGS.items() for s in group}
FAMILY = {u: f for f, us in FAMILIES.items() for u in us}
_ANY = "|".join(sorted(map(re.escape, UNIT), key=len, reverse=True))
_ASKED = rf"(?U)(?:몇\s*|(?i:how many)\s+)({_ANY})(?![A-Za-z])"
_STATED = rf"(?U)[0-9][0-9,.]*\s*[만억천조]?\s*({_ANY})(?:{'|'.join(SUFFIXES)})?(?![가-힣0-9A-Za-z])"
_DATE = r"(?U)[0-9]{1,4}\s*년\s*[0-9]{1,2}\s*월(?:\s*[0-9]{1,2}\s*일)?|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일"


def unit_mismatch(question: Column, value: Column) -> Column:
    """struct<asked, stated>: the spellings where both measure one quantity in different units and the asked one is
    not stated; nulls elsewhere. Spark expressions only."""
    book = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    unit, family = (lambda s: F.try_element_at(book(UNIT), s)), (lambda s: F.try_element_at(book({s: FAMILY[u] for s, u in UNIT.items()}), s))
    asked = F.nullif(F.regexp_extract(F.coalesce(question, F.lit("")), _ASKED, 1), F.lit(""))
    stated = F.regexp_extract_all(F.regexp_replace(F.coalesce(value, F.lit("")), _DATE, " "), F.lit(_STATED), F.lit(1))
    other = F.get(F.filter(stated, lambda s: family(s) == family(asked)), F.lit(0))
    differs = other.isNotNull() & ~F.exists(stated, lambda s: unit(s) == unit(asked))
    return F.struct(F.when(differs, asked).alias("asked"), F.when(differs, other).alias("stated"))
