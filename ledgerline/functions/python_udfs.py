"""The few scalar functions that built-in ones cannot express, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
# What a number, a currency or an estimate begins with.
_STARTS = frozenset("0123456789+-.,~≈$€£¥eEuU")
_GROUPED = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+\Z")


def number(text: str | None) -> float | None:
    """A number as people write it: estimates, currencies, thousands commas and unit suffixes; decimal commas are refused."""
    s = (text or "").strip()
    if _FLOAT.match(s):
        return float(s) if math.isfinite(float(s)) else None
    if s[:1] not in _STARTS:
        return None
    for mark in ("est. ", "est ", "~", "≈"):
        if s.startswith(mark):
            s = s[len(mark) :].lstrip()
    if re.match(r"e [0-9]", s):
        s = s[2:].lstrip()
    elif re.match(r"e[0-9]", s) and "," in s:
        s = s[1:]
    if "," in s and "." in s and s.rindex(",") > s.rindex("."):
        return None
    for mark in ("$", "€", "£", "¥", "USD", "EUR", "usd", "eur"):
        s = s.removeprefix(mark).lstrip() if s.startswith(mark) else s
        s = s.removesuffix(mark).rstrip() if s.endswith(mark) else s
    s = re.sub(r"[ \t\n\r\f]", "", s)
    body = re.match(r"[0-9,.+-]*", s)[0]
    rest = s[len(body) :]
    sign, whole = ("-", body[1:]) if body.startswith("-") else ("", body.removeprefix("+"))
    whole, dot, part = whole.rpartition(".") if "." in whole else (whole, "", "")
    if "," in whole:
        if _GROUPED.match(whole):
            s = sign + whole.replace(",", "") + dot + part + rest
    elif body.startswith("+"):
        s = whole + dot + part + rest
    if not _FLOAT.match(s):
        s = re.match(r"[0-9.+-]*", s)[0]
    return float(s) if _FLOAT.match(s) and math.isfinite(float(s)) else None


@F.pandas_udf(T.DoubleType())
def normalized_number(texts: pd.Series) -> pd.Series:
    return texts.map(number)


_encoded = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
# How the encoder alone would write floats with an exponent, or without a value.
_ODD_FLOAT = re.compile(r"[0-9]e[+-]|NaN|Infinity")


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; floats with a point and the fewest digits."""
    text = _encoded(value)
    return _spelled(value) if _ODD_FLOAT.search(text) else text


def _spelled(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_spelled(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_spelled, value)) + "]"
    if isinstance(value, float):
        text = repr(value)
        if "e" in text:
            head, _, power = text.partition("e")
            return f"{head if '.' in head or abs(int(power)) > 15 else head}e{int(power)}"
        return text
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


_SKIP = re.compile(r"<(?:script.*?</script>|style.*?</style>|!--.*?-->)", re.DOTALL | re.IGNORECASE)
_ANCHOR = re.compile(r"<a(?=[ >\t\n/])[^>]*>(.*?)(?:</a[^>]*>|\Z)", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")
_BLANKS = re.compile(r"[ \t\r\n]+")


def link_density(page: str | None) -> dict:
    """Bytes of text inside and outside links, runs of blanks as one."""
    page = _SKIP.sub("", page or "")
    size = lambda t: len(_BLANKS.sub(" ", _TAG.sub("", t)).encode())
    inside = sum(size(m[1]) for m in _ANCHOR.finditer(page))
    return {"anchor": inside, "other": size(_ANCHOR.sub("<>", page))}


@F.pandas_udf(T.StructType().add("anchor", "long").add("other", "long"))
def anchor_density(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([link_density(p) for p in pages], columns=["anchor", "other"])


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON over several lines, two blanks a level."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False, sort_keys=True))
