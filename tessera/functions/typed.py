"""Typed scalars as native expressions: dates, numbers, ordinals and amounts as comparable integers.

Two parsers exist on purpose: the lenient one groups values of trust analytics, the exact one serves comparisons.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default units of amounts, the scale of numbers, and the bound of amounts.
UNITS = {"원": 1, "천": 10**3, "만": 10**4, "억": 10**8, "조": 10**12}
SCALE = 1000
TYPES = ("date", "number", "ordinal", "amount")
NUM = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
DATE = r"^([0-9]{4})[.\-/]([0-9]{1,2})(?:[.\-/]([0-9]{1,2}))?$"
DATE_CALL = r"(?i)^date\(\s*([0-9]{4})\s*,\s*([0-9]{1,2})(?:\s*,\s*([0-9]{1,2}))?\s*\)$"
NUMBER_CALL = rf'(?i)^number\(\s*"?({NUM})"?\s*\)$'
ORDINALS = [r"^제?([0-9]+)\s*(?:호|위|번|차|등|째)$", r"(?i)^([0-9]+)\s*(?:st|nd|rd|th)$", r"(?i)^ordinal\(\s*([0-9]+)\s*\)$"]
AMOUNT = rf"^({NUM}) ?([^0-9]+)$"
AMOUNT_CALL = rf'(?i)^amount\(\s*"?({NUM})"?\s*,\s*(?:"([^"]*)"|([^,)"]+))\s*\)$'

#: The decimal digits of all scripts but ASCII, and the ASCII digits they stand for.
WIDE = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdecimal())
PLAIN = "".join(str(unicodedata.decimal(c)) for c in WIDE)


def _plain(c: Column) -> Column:
    """Digits of all scripts as ASCII ones; a text in ASCII is passed on."""
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), F.translate(c, WIDE, PLAIN)).otherwise(c)


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _decimal(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,9)")


def _whole(c: Column) -> Column:
    """Half up, away from zero; null where it leaves the range of a long."""
    return F.round(c, 0).try_cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date(parts: Column) -> Column:
    """yyyymmdd of the struct y, m, d where it is a day of the calendar; by arithmetic, as parsing one is far slower."""
    y, m, d = parts["y"], parts["m"], parts["d"]
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when(leap, 29).otherwise(28)
    return F.when((y > 0) & m.between(1, 12) & (d >= 1) & (d <= days), (y * 10000 + m * 100 + d).cast("long"))


def date_key(c: Column) -> Column:
    """yyyymmdd; the day defaults to 1; null for text that is no date or a day that does not exist."""

    def parsed(c):
        call = (F.lower(F.substring(c, 1, 5)) == "date(") & F.rlike(c, F.lit(DATE_CALL))
        pick = lambda pattern, g: F.regexp_extract(c, pattern, g).try_cast("int")  # noqa: E731  (no text is no number)
        parts = lambda p: F.struct(pick(p, 1).alias("y"), pick(p, 2).alias("m"), F.coalesce(pick(p, 3), F.lit(1)).alias("d"))
        return _let(F.when(call, parts(DATE_CALL)).when(F.rlike(c, F.lit(DATE)), parts(DATE)), _date)

    return _let(_plain(c), parsed)


def number_key(c: Column) -> Column:
    c = _plain(c)
    n = F.coalesce(F.when(F.rlike(c, F.lit(f"^{NUM}$")), c), _part(c, NUMBER_CALL, 1))
    return _whole(_decimal(n) * SCALE)


def ordinal_key(c: Column) -> Column:
    return F.coalesce(*[_part(_plain(c), p, 1) for p in ORDINALS]).try_cast("long")


def amount_key(c: Column, units: dict[str, int] | None = None) -> Column:
    """Number times unit. A trailing currency mark after a unit is dropped; unknown units give null."""
    known, c = {**UNITS, **(units or {})}, _plain(c)
    book = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
    called = _part(c, AMOUNT_CALL, 1)
    number = F.coalesce(called, _part(c, AMOUNT, 1))
    unit = F.trim(F.when(called.isNotNull(), F.coalesce(_part(c, AMOUNT_CALL, 2), _part(c, AMOUNT_CALL, 3))).otherwise(_part(c, AMOUNT, 2)))
    bare = F.when(F.length(unit) > 1, F.trim(F.regexp_replace(unit, "원$", "")))
    factor = F.coalesce(F.try_element_at(book, unit), F.try_element_at(book, bare))
    return _whole(_decimal(number) * factor.cast("decimal(20,0)"))


def typed_key(kind: str, c: Column, units: dict[str, int] | None = None) -> Column:
    return {"date": date_key, "number": number_key, "ordinal": ordinal_key}[kind](c) if kind != "amount" else amount_key(c, units)


def exact_key(kind: str, c: Column, units: dict[str, int] | None = None) -> Column:
    """The stricter parser of comparisons: ISO dates, well-formed thousands groups, exact units, whole products."""
    if kind == "date":
        there = F.rlike(c, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & ~F.startswith(c, F.lit("0000")) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()
        return F.when(there, F.replace(c, F.lit("-"), F.lit("")).try_cast("long"))
    grouped = r"-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?"
    if kind == "number":
        value = _decimal(F.when(F.rlike(c, F.lit(f"^{grouped}$")), c)) * SCALE
    elif kind == "ordinal":
        return ordinal_key(c)
    else:
        known = {**UNITS, **(units or {})}
        book = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
        pattern = rf"^({grouped}) ?([^0-9.,\s-]+)$"
        value = _decimal(_part(c, pattern, 1)) * F.try_element_at(book, _part(c, pattern, 2)).cast("decimal(20,0)")
    return F.when(value == F.round(value, 0), value.try_cast("long"))


def sql_key(kind: str, c: str) -> str:
    """The exact parser's value as DuckDB SQL, for oracles over ASCII text."""
    if kind == "date":
        return f"CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({c} AS DATE) IS NOT NULL THEN CAST(replace({c}, '-', '') AS BIGINT) END"
    if kind == "number":
        return f"CASE WHEN regexp_full_match({c}, '-?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?') THEN CAST(CAST(replace({c}, ',', '') AS DECIMAL(30,6)) * 1000 AS BIGINT) END"
    if kind == "ordinal":
        return f"CASE WHEN regexp_full_match({c}, '[0-9]+(st|nd|rd|th)') THEN CAST(regexp_extract({c}, '^[0-9]+') AS BIGINT) END"
    units = " ".join(f"WHEN '{k}' THEN {v}" for k, v in UNITS.items())
    return f"CASE WHEN regexp_full_match({c}, '-?[0-9]+(\\.[0-9]+)?.') THEN CAST(CAST(regexp_extract({c}, '^-?[0-9.]+') AS DECIMAL(20,6)) * CASE right({c}, 1) {units} END AS BIGINT) END"
