"""Intents of questions: reading the simple English and Korean forms, and checking intents that a model proposes.

A question is read by words: an opening of a few words says which form it has, then marks between its words (a
possessive, "of", a particle) part the entity from the relation asked for. No pattern spans the whole question.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .. import terms

# Relation labels of the question forms, and words that name nothing.
ROLE_LABELS = {"ko": ["역할", "직책", "직위"], "en": ["role", "title", "position", "has_role"]}
PURPOSE_LABELS = ["목적", "목표", "purpose", "objective", "goal"]
VAGUE = {"anything", "it", "something", "that", "this"}
OPENINGS = {("what", "is"): "ask", ("what", "was"): "ask", ("find",): "ask", ("show",): "ask", ("how", "is"): "how", ("how", "was"): "how", ("which", "relation", "connects"): "which", ("what", "does"): "does"}
VERBS = ["provide", "provides", "offer", "offers", "connect", "connects", "relate", "relates"]
ASKED, TOPICS, POSSESSIVE = ["무엇", "뭐", "언제", "누구", "어디"], ["는", "은", "이", "가"], "의"
QUOTES = "\"'“”"
#: Longest entity and label, in characters.
MOST_ENTITY, MOST_LABEL = 100, 80


@dataclass
class Intent:
    kind: str
    entity: str = ""
    relations: list[str] = field(default_factory=list)
    reason: str = ""


def _labels(label: str) -> list[str]:
    """The relation labels that an asked label may stand for."""
    words = " ".join(label.split())
    if words.lower() in PURPOSE_LABELS:
        return list(PURPOSE_LABELS)
    return list(dict.fromkeys([words, words.replace(" ", "_"), words.lower().replace(" ", "_")]))


def _named(words: list[str]) -> str:
    """An English entity: words of which the first begins with a capital; else nothing."""
    name = " ".join(words)
    return name if name[:1].isascii() and name[:1].isupper() and len(name) <= MOST_ENTITY and name.lower() not in VAGUE else ""


def _label(words: list[str]) -> str:
    """An English label: ASCII letters, digits, blanks, dashes and underscores, a letter first."""
    label = " ".join(words)
    return label if label[:1].isalpha() and len(label) <= MOST_LABEL and all(c.isascii() and (c.isalnum() or c in " _-") for c in label) else ""


def _asked_in_english(words: list[str]) -> Intent | None:
    """What follows "what is": X's LABEL, the LABEL of X, or X ROLE."""
    if words and words[0].lower() == "the":
        words = words[1:]
    owner = next((i for i, w in enumerate(words) if w.endswith("'s")), None)
    if owner is not None:
        entity, label = _named([*words[:owner], words[owner][:-2]]), _label(words[owner + 1 :])
    elif "of" in (lower := [w.lower() for w in words]):
        cut = lower.index("of")
        entity, label = _named(words[cut + 1 :]), _label(words[:cut])
    else:
        entity, label = _named(words[:-1]), _label(words[-1:])
        if label.lower() not in ROLE_LABELS["en"][:3]:
            return None
    if not entity or not label:
        return None
    return Intent("lookup_object", entity, list(ROLE_LABELS["en"]) if label.lower() in ROLE_LABELS["en"][:3] else _labels(label))


def _english(text: str) -> Intent | None:
    words = text.replace("’", "'").split()
    lower = [w.lower() for w in words]
    form, size = next(((f, len(o)) for o, f in OPENINGS.items() if tuple(lower[: len(o)]) == o), (None, 0))
    rest, last = words[size:], lower[-1:]
    if form == "ask":
        return _asked_in_english(rest)
    if form == "how" and last == ["related"] and (entity := _named(rest[:-1])):
        return Intent("discover", entity)
    if form == "which" and lower[-3:] == ["to", "other", "facts"] and (entity := _named(rest[:-3])):
        return Intent("discover", entity)
    if form == "does" and last and last[0] in VERBS and (entity := _named(rest[:-1])):
        return Intent("discover", entity, _labels(last[0]))
    return None


def _korean(text: str) -> Intent | None:
    """X의 LABEL은 무엇…, X에 대한 LABEL…, X는 어떤 관계…, X가 제공하는 것…."""
    words = text.split()
    for i, word in enumerate(words):
        entity = " ".join([*words[:i], word])
        rest = words[i + 1 :]
        about = bool(rest) and rest[0] == "대한" and word.endswith("에")
        if rest and (word.endswith(POSSESSIVE) or about):
            entity, said = entity[:-1].strip(QUOTES + " "), " ".join(rest[1:] if about else rest)
            if not entity or len(entity) > MOST_ENTITY:
                return None
            if any(said.startswith(r) for r in ROLE_LABELS["ko"]):
                return Intent("lookup_object", entity, list(ROLE_LABELS["ko"]))
            at = min((said.find(a) for a in ASKED if a in said), default=-1)
            label = said[:at].strip() if at > 0 else ""
            label = label[:-1].strip() if label[-1:] in TOPICS else label
            return Intent("lookup_object", entity, _labels(label)) if label and len(label) <= MOST_LABEL else None
        if rest and word[-1] in TOPICS:
            entity, said = entity[:-1].strip(QUOTES + " "), " ".join(rest)
            if entity and said.startswith("어떤 관계"):
                return Intent("discover", entity)
            if entity and said.startswith("제공하는 것"):
                return Intent("discover", entity, ["제공"])
    return None


def read_intent(question: str) -> Intent:
    """The intent of a question in one of the known forms, else kind unsupported."""
    text = question.strip().rstrip("?？ \t")
    korean = any("가" <= c <= "힣" for c in text)
    found = (_korean(text) if korean else None) or _english(text)
    if found and found.entity and found.entity.lower() not in VAGUE:
        return found
    return Intent("unsupported", reason="no known question form")


# The kinds of intents that a model may propose, with the targets each needs, and value domains.
NEEDS = {
    "lookup_object": ("subject", "relation"), "lookup_subject": ("relation", "object"), "lookup_relation": ("subject", "object"), "discover_entity_relations": ("subject",),
    "compare_typed_value": ("relation",), "conjunctive_lookup": (), "conjunctive_filter": (), "conjunctive_three_hop_lookup": (), "unknown_or_unsupported": (),
}
TARGET_KINDS, OPERATORS, VALUE_TYPES = {"entity", "relation", "value", "typed_value"}, {"=", "!=", "<", "<=", ">", ">="}, {"date", "number", "ordinal", "amount"}


def _target(x, name: str) -> str:
    if not isinstance(x, dict) or x.get("kind") not in TARGET_KINDS or not isinstance(x.get("value"), str) or not x["value"].strip():
        raise ValueError(f"{name} is no target")
    return terms.nfc(x["value"].strip())


def _end(x) -> tuple[str, str]:
    """An end of a hop: (entity, its name) or (var, a variable)."""
    if not isinstance(x, dict) or x.get("kind") not in ("entity", "var") or not str(x.get("value") or "").strip():
        raise ValueError("a hop has an end that is neither entity nor variable")
    value = x["value"].strip()
    if x["kind"] == "var" and not (value.isascii() and value.replace("_", "a").isalnum() and value[0].isupper()):
        raise ValueError(f"{value} is no variable")
    return x["kind"], terms.nfc(value)


def _hops(rows, least: int, most: int) -> list[tuple]:
    if not isinstance(rows, list) or not least <= len(rows) <= most:
        raise ValueError("a wrong number of hops")
    return [(_end(r.get("subject")), _target(r.get("relation"), "a hop's relation"), _end(r.get("object"))) for r in rows]


def check_intent(text: str) -> dict:
    """The proposed intent in a model's text: the first JSON object in it, its shape and values checked.

    Fields that a kind doesn't use are ignored, but values outside their domains are refused on every kind.
    Raises ValueError.
    """
    at = text.find("{")
    if at < 0:
        raise ValueError("no JSON object")
    raw, _ = json.JSONDecoder().raw_decode(text[at:])
    kind = raw.get("kind")
    if kind not in NEEDS:
        raise ValueError(f"unknown kind {kind!r}")
    for name, domain in (("operator", OPERATORS), ("value_type", VALUE_TYPES)):
        if raw.get(name) is not None and raw[name] not in domain:
            raise ValueError(f"{name} {raw[name]!r} is outside its domain")
    out = {"kind": kind, **{n: _target(raw.get(n), n) for n in NEEDS[kind]}}
    if kind == "unknown_or_unsupported":
        if not str(raw.get("reason") or "").strip():
            raise ValueError("an unsupported question needs a reason")
        out["reason"] = raw["reason"].strip()
    if kind == "compare_typed_value":
        if raw.get("object") is not None:
            raise ValueError("a comparison takes no object")
        if not all(str(raw.get(n) or "").strip() for n in ("operator", "value_type", "value")):
            raise ValueError("a comparison needs operator, value_type and value")
        out |= {n: raw[n] for n in ("operator", "value_type", "value")}
    if kind in ("conjunctive_lookup", "conjunctive_three_hop_lookup"):
        n = 2 if kind == "conjunctive_lookup" else 3
        out["hops"] = _hops(raw.get("hops" if n == 2 else "chain_hops"), n, n)
        ends = out["hops"]
        if ends[0][0][0] != "entity" or any(a[2] != b[0] or a[2][0] != "var" for a, b in zip(ends, ends[1:], strict=False)):
            raise ValueError("the hops are no chain from an entity")
    if kind == "conjunctive_filter":
        out["hops"] = _hops(raw.get("conditions"), 2, 2)
        answers = [{e for e in (h[0], h[2]) if e[0] == "var"} for h in out["hops"]]
        if any(len(a) != 1 for a in answers) or answers[0] != answers[1]:
            raise ValueError("the conditions share no single answer variable")
    if extra := [r for r in raw.get("relation_candidates") or [] if not isinstance(r, str) or not r.strip()]:
        raise ValueError(f"relation candidates that are no labels: {extra}")
    out["relations"] = [terms.nfc(r.strip()) for r in raw.get("relation_candidates") or []]
    return out
