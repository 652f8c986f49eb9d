"""Decoding of extraction records that a model returned as text. One bad item fails its whole batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms

# Keys under which a batch may stand.
KEYS = ("facts", "items", "data", "results")
SLOTS = ("subject", "relation", "object")
RECORD = "struct<facts:array<struct<subject:string,subject_kind:string,relation:string,relation_kind:string,object:string,object_kind:string,confidence:double,note:string>>,error:string>"


def _first_value(raw: str):
    """The first JSON value of a text that may begin with prose."""
    decoder, text = json.JSONDecoder(), raw.strip()
    try:
        return decoder.raw_decode(text)[0]
    except ValueError:
        at = min((i for i in map(text.find, "[{") if i >= 0), default=-1)
        if at < 0:
            raise
        return decoder.raw_decode(text[at:])[0]


def _text(x, what: str) -> str:
    if not isinstance(x, str):
        raise ValueError(f"{what} is no string")
    return x.strip()


def _slot(item: dict, name: str) -> tuple[str, str]:
    raw = item[name]
    value, kind = (_text(raw, name), "string") if isinstance(raw, str) else (_text(raw["value"], name), _text(raw["kind"], name))
    if kind not in ("string", "term") or not value:
        raise ValueError(f"{name} is empty or of an unknown kind")
    if kind == "term" and not terms.is_ground(terms.parse(value)):
        raise ValueError(f"{name} has variables")
    return value, kind


def decode_batch(raw: str) -> list[dict]:
    """The facts of one batch; ValueError where anything is off its schema."""
    try:
        data = _first_value(raw)
        items = data if isinstance(data, list) else next(data[k] for k in KEYS if isinstance(data.get(k), list))
        out = []
        for item in items:
            row: dict = {}
            for name in SLOTS:
                row[name], row[name + "_kind"] = _slot(item, name)
            c = item["confidence"]
            if isinstance(c, bool) or not 0.0 <= float(c) <= 1.0:
                raise ValueError("confidence is no number from 0 to 1")
            row["confidence"] = float(c)
            row["note"] = "" if item.get("note") is None else _text(item["note"], "note")
            out.append(row)
        return out
    except (KeyError, TypeError, AttributeError, StopIteration, ValueError) as e:
        raise ValueError(f"malformed batch: {e}") from e


def decode(c: Column) -> Column:
    """struct<facts, error> of a column of model outputs: error set and no facts where a batch is malformed."""

    def each(s: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in s:
            try:
                rows.append((decode_batch(raw or ""), None))
            except ValueError as e:
                rows.append(([], str(e)))
        return pd.DataFrame(rows, columns=["facts", "error"])

    return F.pandas_udf(each, RECORD)(c)
