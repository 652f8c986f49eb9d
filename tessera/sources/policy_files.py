"""Policy text files: relation aliases, typed relations, functional declarations, and the .dl text of facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from ..functions import typed

# Default aliases by canonical label.
DEFAULT_ALIASES = {
    "provides": ["제공", "제공기능", "제공 기능", "제공서비스", "제공 서비스", "제공요소", "제공 요소"],
    "purpose": ["목적", "목표", "프로젝트 목적", "사업 목적", "objective", "goal"],
    "role": ["역할", "직책", "직위"],
    "affiliation": ["소속"],
    "established_on": ["설립", "설립일", "설립연도", "창립", "창립일", "established", "founded", "founded_on"],
    "born_on": ["출생", "출생일", "생년월일", "born", "birth_date", "date_of_birth"],
    "died_on": ["사망", "사망일", "died", "death_date", "date_of_death"],
}


class PolicyError(ValueError):
    """A policy file that cannot be used."""


def _label(token: str, line: int) -> str:
    t = token.strip()
    if "`" in t:
        if len(t) < 3 or t[0] != "`" or t[-1] != "`" or "`" in t[1:-1]:
            raise PolicyError(f"line {line}: backticks do not match")
        t = t[1:-1].strip()
    if not t:
        raise PolicyError(f"line {line}: an empty label")
    return terms.nfc(t)


def parse_aliases(text: str) -> dict[str, str]:
    """raw label -> canonical label. No label is both, so there are no chains."""
    out: dict[str, str] = {}
    for i, line in enumerate(text.splitlines(), 1):
        row = re.sub(r"^\s*[-*] ", "", line).strip()
        if not row or row.startswith("#"):
            continue
        sides = row.split("->")
        if len(sides) != 2:
            raise PolicyError(f"line {i}: expected one ->")
        raw, canonical = (_label(s, i) for s in sides)
        if raw == canonical:
            raise PolicyError(f"line {i}: {raw} maps to itself")
        if out.setdefault(raw, canonical) != canonical:
            raise PolicyError(f"line {i}: {raw} has two canonical labels")
    if both := sorted(set(out) & set(out.values())):
        raise PolicyError(f"labels that are both raw and canonical: {', '.join(both)}")
    return out


def with_defaults(user: dict[str, str]) -> dict[str, str]:
    """User aliases over the defaults; a default gives way where it would chain with a user's."""
    base = {terms.nfc(raw): c for c, raws in DEFAULT_ALIASES.items() for raw in raws}
    kept = {r: c for r, c in base.items() if r not in user.values() and c not in user}
    return {**kept, **user}


def canonical(label: str, aliases: dict[str, str]) -> str:
    if not aliases:
        return label
    n = terms.nfc(label)
    return aliases.get(n, n if n in aliases.values() else label)


def variants(label: str, aliases: dict[str, str]) -> list[str]:
    """All labels that mean the same: the label, its canonical one, and the others mapped to that."""
    c = canonical(label, aliases)
    rest = sorted(r for r, to in aliases.items() if to == c)
    return list(dict.fromkeys([terms.nfc(label), c, *rest]))


def label_variants(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, variant): every label of a table (label) with itself, its canonical label and all others that mean
    that; labels and aliases (raw, canonical) are NFC. Two joins along the aliases, nothing on the driver."""
    a = aliases.select("raw", "canonical").distinct()
    said = labels.select("label").distinct()
    own = said.join(a, said["label"] == a["raw"], "left").select("label", F.coalesce("canonical", "label").alias("canonical"))
    rest = own.join(a, "canonical").select("label", F.col("raw").alias("variant"))
    return own.select("label", F.explode(F.array("label", "canonical")).alias("variant")).unionByName(rest).distinct()


def alias_frame(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "raw string, canonical string")


def canonicalize(facts: DataFrame, aliases: DataFrame, column: str = "relation") -> DataFrame:
    """Adds canonical: the alias table's label, else the label itself. Labels are NFC already (see nfc at load)."""
    a = aliases.select(F.col("raw").alias("__raw"), F.col("canonical").alias("__canonical"))
    return facts.join(a, facts[column] == F.col("__raw"), "left").withColumn("canonical", F.coalesce("__canonical", column)).drop("__raw", "__canonical")


_TYPED = re.compile(r"^(?:`(?P<quoted>[^`]+)`|(?P<name>\S+))\s*:\s*(?P<type>\w+)\s+as\s+(?P<alias>\S+)(?:\s*\((?P<units>[^)]*)\))?\s*$")


def parse_typed_relations(text: str) -> dict[str, dict]:
    """relation -> {type, alias, units}. Lines of another form or type are skipped; contradictions raise."""
    out: dict[str, dict] = {}
    owner: dict[str, str] = {}
    for i, line in enumerate(text.splitlines(), 1):
        m = _TYPED.match(re.sub(r"^\s*[-*] ", "", line).strip())
        if not m or m["type"] not in typed.TYPES:
            continue
        name, units = terms.nfc((m["quoted"] or m["name"]).strip()), {}
        if m["units"] is not None:
            if m["type"] != "amount":
                raise PolicyError(f"line {i}: only amounts have units")
            for part in filter(None, map(str.strip, m["units"].split(","))):
                unit, eq, value = part.partition("=")
                if not eq or not unit.strip() or not value.strip().isdecimal() or int(value) <= 0:
                    raise PolicyError(f"line {i}: malformed unit {part!r}")
                units[terms.nfc(unit.strip())] = int(value)
        if owner.setdefault(m["alias"], name) != name:
            raise PolicyError(f"line {i}: alias {m['alias']} is taken")
        out[name] = {"type": m["type"], "alias": m["alias"], "units": units}
    return out


def export_dl(facts: DataFrame) -> DataFrame:
    """Sorted distinct lines relation("s", "r", "o"). of subject, relation, object strings; control marks escaped."""
    from ..functions import text

    quoted = lambda c: F.concat(F.lit('"'), F.replace(text.escape(F.col(c)), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("relation("), quoted("subject"), F.lit(", "), quoted("relation"), F.lit(", "), quoted("object"), F.lit(")."))
    return facts.select(line.alias("line")).distinct().orderBy("line")


def import_dl(text: str) -> list[tuple[str, str, str]]:
    """The triples of a .dl text."""
    from ..datalog import parse_program

    return [tuple(map(terms.surface, f.args)) for f in parse_program(text).facts if f.name == "relation" and len(f.args) == 3]


# How a policy file stands to what was recorded of it; the first and last may run.
PRESENT, PRESENT_EMPTY, MISSING_RECORDED, UNRECORDED_DEFAULT = "present", "present_empty", "missing_recorded", "unrecorded_default"


def policy_state(text: str | None, recorded: bool) -> str:
    """text: the file's, None without a file; recorded: whether a policy was ever stored for this knowledge base."""
    if text is not None:
        return PRESENT if text.lstrip("﻿").strip() else PRESENT_EMPTY
    return MISSING_RECORDED if recorded else UNRECORDED_DEFAULT


def runnable_policy(text: str | None, recorded: bool, default: str) -> tuple[str, list[str]]:
    """(policy, warnings) to run; PolicyError where rules once recorded are gone or the file says nothing."""
    state = policy_state(text, recorded)
    if state == PRESENT:
        return text, []
    if state == UNRECORDED_DEFAULT:
        return default, ["WARN policy_unrecorded: no policy file; the default policy ran"]
    raise PolicyError(f"the policy may not run: {state}")


def mark_policy(known: dict | None, text: str, now: str, revision: int | None = None) -> dict:
    """The record of a policy once its text was seen: sha, first_seen, last_seen and revision.

    known: the record as it stands. revision: the one the caller read; another one meanwhile is an error, so two
    writers never overwrite each other. The same text keeps its revision; a new one gets the next.
    """
    import hashlib

    have = known["revision"] if known else 0
    if revision is not None and revision != have:
        raise PolicyError(f"the policy's record is at revision {have}, not {revision}")
    sha = hashlib.sha256(text.encode()).hexdigest()
    if known and known["sha"] == sha:
        return {**known, "last_seen": now}
    return {"sha": sha, "first_seen": now, "last_seen": now, "revision": have + 1}
