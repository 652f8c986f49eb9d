"""Ground and open terms, their text form, and their two equalities.

Storage identity is the canonical JSON of a term. Engine equality is its compare key: atoms, strings and numbers
with the same surface are one value; compounds are equal by structure only. Strings and keys are NFC throughout,
so a term keys the same before and after storage.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache


class TermError(ValueError):
    """A text or JSON value that is no term."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    name: str


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Num:
    value: int


@dataclass(frozen=True)
class Comp:
    functor: str
    args: tuple


Term = Var | Atom | Str | Num | Comp

VAR = re.compile(r"[A-Z][A-Za-z0-9_]*")
ATOM = re.compile(r"[a-z_][A-Za-z0-9_]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?![0-9A-Za-z_]|\.[0-9])")
SPACE = re.compile(r"\s*")
# Escapes of string literals, and what is escaped when shown (categories and bidi controls).
ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
SHOWN = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
HIDDEN_CATEGORIES = {"Cc", "Zl", "Zp"}
BIDI = {0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069}


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class Reader:
    """A cursor over text, with the term grammar. Programs read their statements with the same cursor."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def fail(self, what: str):
        raise TermError(f"{what} at {self.at}: {self.text[self.at : self.at + 20]!r}")

    def space(self) -> None:
        self.at = SPACE.match(self.text, self.at).end()

    def take(self, token: str) -> bool:
        self.space()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def want(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"expected {token!r}")

    def match(self, pattern: re.Pattern) -> str | None:
        self.space()
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            return m.group()
        return None

    def string(self) -> str:
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == '"':
                return "".join(out)
            if c in "\r\n":
                self.fail("line end inside a string")
            if c != "\\":
                out.append(c)
                continue
            kind = self.text[self.at : self.at + 1]
            self.at += 1
            if kind in ESCAPES:
                out.append(ESCAPES[kind])
            elif kind in ("u", "U"):
                n = 4 if kind == "u" else 8
                digits = self.text[self.at : self.at + n]
                if len(digits) < n or not re.fullmatch(r"[0-9A-Fa-f]+", digits):
                    self.fail("bad unicode escape")
                code = int(digits, 16)
                if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                    self.fail("no such character")
                self.at += n
                out.append(chr(code))
            else:
                self.fail("unknown escape")
        self.fail("string without end")

    def arguments(self) -> tuple:
        """What follows an opening bracket, the closing one included."""
        if self.take(")"):
            return ()
        args = [self.term()]
        while self.take(","):
            args.append(self.term())
        self.want(")")
        return tuple(args)

    def term(self) -> Term:
        if self.take('"'):
            return Str(nfc(self.string()))
        if (n := self.match(NUMBER)) is not None:
            return Num(int(n))
        if name := self.match(VAR):
            return Var(name)
        if name := self.match(ATOM):
            return Comp(name, self.arguments()) if self.text.startswith("(", self.at) and self.take("(") else Atom(name)
        self.fail("no term")


def parse(text: str) -> Term:
    r = Reader(text)
    out = r.term()
    r.space()
    if r.at != len(text):
        r.fail("text after the term")
    return out


def escape(value: str) -> str:
    """A string so that it shows on one line, in order: line makers, controls and bidi marks as escapes."""
    if value.isascii() and value.isprintable() and "\\" not in value:
        return value
    out = []
    for c in value:
        if c in SHOWN:
            out.append(SHOWN[c])
        elif unicodedata.category(c) in HIDDEN_CATEGORIES or ord(c) in BIDI:
            out.append(f"\\u{ord(c):04X}" if ord(c) < 0x10000 else f"\\U{ord(c):08X}")
        else:
            out.append(c)
    return "".join(out)


def render(t: Term) -> str:
    """Text that parses back to the term."""
    match t:
        case Var(name) | Atom(name):
            return name
        case Num(value):
            return str(value)
        case Str(value):
            return '"' + escape(value).replace('"', '\\"') + '"'
        case Comp(functor, args):
            return f"{functor}({', '.join(map(render, args))})"


def surface(t: Term) -> str:
    """A label without quotes."""
    match t:
        case Str(value):
            return value
        case _:
            return render(t)


def shown(t: Term) -> str:
    """As surface, with strings escaped for display."""
    return escape(t.value) if isinstance(t, Str) else render(t)


def answer(t: Term) -> str:
    """As shown, with the commas of strings escaped, since answers are joined by commas."""
    return shown(t).replace(",", "\\,") if isinstance(t, Str) else render(t)


def is_ground(t: Term) -> bool:
    return not isinstance(t, Var) and (not isinstance(t, Comp) or all(map(is_ground, t.args)))


def variables(t: Term):
    if isinstance(t, Var):
        yield t.name
    elif isinstance(t, Comp):
        for a in t.args:
            yield from variables(a)


def _plain(t: Term):
    match t:
        case Atom(name):
            return {"t": "atom", "v": name}
        case Str(value):
            return {"t": "string", "v": nfc(value)}
        case Num(value):
            return {"t": "number", "v": value}
        case Comp(functor, args):
            return {"a": [_plain(a) for a in args], "f": functor, "t": "compound"}
    raise TermError("a stored term has no variables")


def to_json(t: Term) -> str:
    return json.dumps(_plain(t), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _term(x) -> Term:
    keys = {"atom": {"t", "v"}, "string": {"t", "v"}, "number": {"t", "v"}, "compound": {"a", "f", "t"}}
    if not isinstance(x, dict) or set(x) != keys.get(x.get("t"), {None}):
        raise TermError("no stored term")
    match x["t"]:
        case "string" if isinstance(x["v"], str):
            return Str(x["v"])
        case "atom" if isinstance(x["v"], str) and ATOM.fullmatch(x["v"]):
            return Atom(x["v"])
        case "number" if type(x["v"]) is int:
            return Num(x["v"])
        case "compound" if isinstance(x["f"], str) and ATOM.fullmatch(x["f"]) and isinstance(x["a"], list):
            return Comp(x["f"], tuple(map(_term, x["a"])))
    raise TermError("no stored term")


@lru_cache(maxsize=65536)
def from_json(text: str) -> Term:
    """Strict: the text must be what to_json gives."""
    try:
        out = _term(json.loads(text))
    except (ValueError, AttributeError, TypeError) as e:
        raise TermError(f"no stored term: {text[:80]}") from e
    if to_json(out) != text:
        raise TermError(f"not canonical: {text[:80]}")
    return out


def key(t: Term) -> str:
    """The compare key of engine equality."""
    match t:
        case Var(name):
            return "v:" + name
        case Comp():
            return "c:" + to_json(t)
        case Str(value):
            return "s:" + nfc(value)
        case _:
            return "s:" + render(t)
