"""Metadata filters as one Boolean column over a document's path and front matter."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T

KEYS = ("path", "exclude_path", "type", "tags", "tags_any", "date_from", "date_to", "as_of", "meta")
OPS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "exists")


def _listed(value) -> list[str]:
    return [] if value in (None, "") else [value] if isinstance(value, str) else [str(v) for v in value]


def checked(spec: Mapping) -> dict:
    """spec if its keys, operators and dates are known ones; else ValueError."""
    if bad := set(spec) - set(KEYS):
        raise ValueError(f"unknown filter keys {sorted(bad)}; known are {KEYS}")
    for field, wanted in (spec.get("meta") or {}).items():
        if isinstance(wanted, Mapping) and (bad := set(wanted) - set(OPS)):
            raise ValueError(f"unknown operators {sorted(bad)} for {field}; known are {OPS}")
    for key in ("date_from", "date_to", "as_of"):
        if spec.get(key) and not re.match(r"\d{4}(-\d{2}(-\d{2})?)?", str(spec[key])):
            raise ValueError(f"{key} must be an ISO date, not {spec[key]!r}")
    return dict(spec)


def glob(path: Column, pattern: str) -> Column:
    """path matches a shell pattern (*, ?, [...]) as a whole, case counting; * crosses folders."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "[" and (end := pattern.find("]", i + 1 + pattern.startswith("!", i))) >= 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return path.rlike(f"(?s)^(?:{out})$")


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""^['"]+|['"]+$""", "")


def _one(value: Column, op: str, wanted) -> Column:
    """A comparison as numbers where both are, else as lower-case strings."""
    text = str(wanted).lower() if isinstance(wanted, bool) else str(wanted)
    own, number = _bare(value), _bare(value).try_cast("double")
    bare = text.strip().strip("'\"")
    try:
        asked = float(bare)
    except ValueError:
        asked = None
    if op in ("eq", "ne"):
        same = number.isNotNull() & (number == asked) if asked is not None else number.isNull() & (F.lower(own) == bare.lower())
        return same if op == "eq" else ~same
    if op == "contains":
        return F.contains(F.lower(value), F.lit(text.lower()))
    pick = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
    low, as_text = F.lower(F.trim(value)), text.strip().lower()
    if asked is None:
        return pick(F.when(number.isNull(), F.lower(own)).otherwise(low), F.when(number.isNull(), F.lit(bare.lower())).otherwise(as_text))
    return F.when(number.isNotNull(), pick(number, F.lit(asked))).otherwise(pick(low, F.lit(as_text)))


def meta(value: Column, wanted) -> Column:
    """A front matter field under one value or {operator: value, ...}, all of which must hold; a missing field meets exists: false only."""
    there = value.isNotNull() & (value != "")
    out = F.lit(True)
    for op, asked in (wanted if isinstance(wanted, Mapping) else {"eq": wanted}).items():
        if op == "exists":
            out = out & (there if asked else ~there)
        elif op in ("in", "nin"):
            hit = F.lit(False)
            for a in _listed(asked):
                hit = hit | _one(value, "eq", a)
            out = out & there & (hit if op == "in" else ~hit)
        else:
            out = out & there & _one(value, op, asked)
    return F.coalesce(out, F.lit(False))


def condition(spec: Mapping, path: str = "doc_path", front: str = "meta") -> Column:
    """Whether a document passes all of spec but as_of's supersession, which looks at other documents: see filtered()."""
    spec = checked(spec)
    field = lambda name: F.col(front)[name]
    unix, out = F.translate(F.col(path), "\\", "/"), F.lit(True)
    if globs := _listed(spec.get("path")):
        out = out & _any([glob(unix, g) for g in globs])
    if globs := _listed(spec.get("exclude_path")):
        out = out & ~_any([glob(unix, g) for g in globs])
    if kinds := _listed(spec.get("type")):
        out = out & F.lower(F.trim(F.coalesce(field("type"), F.lit("")))).isin(*(k.lower() for k in kinds))
    for key, meets in (("tags", lambda have, asked: F.size(F.array_except(asked, have)) == 0), ("tags_any", F.arrays_overlap)):
        if asked := _listed(spec.get(key)):
            wanted = T.tag_set(F.lit(", ".join(asked)))
            out = out & meets(T.tag_set(F.coalesce(field("tags"), F.lit(""))), wanted)
    date = T.iso_date(field("date"))
    if low := spec.get("date_from"):
        out = out & (date >= str(low))
    if high := spec.get("date_to"):
        out = out & (F.substring(date, 1, len(str(high))) <= str(high))
    if day := spec.get("as_of"):
        start = start_of(F.col(front))
        out = out & (start.isNull() | (start <= str(day)))
    for name, wanted in (spec.get("meta") or {}).items():
        out = out & meta(field(name), wanted)
    return F.coalesce(out, F.lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def start_of(front: Column) -> Column:
    """The day from which a document is in force: its effective date, else its date."""
    return F.coalesce(T.iso_date(front["effective"]), T.iso_date(front["date"]))


def filtered(docs: DataFrame, spec: Mapping, path: str = "doc_path", front: str = "meta") -> DataFrame:
    """The rows of docs that pass spec. With as_of, documents that another one in force by then names in supersedes go by an anti-join."""
    kept = docs.filter(condition(spec, path, front))
    if not spec.get("as_of"):
        return kept
    newer = docs.filter(start_of(F.col(front)) <= str(spec["as_of"])).select(F.explode(F.split(F.col(front)["supersedes"], r"\s*,\s*")).alias("_old"))
    newer = newer.select(F.translate(F.trim("_old"), "\\", "/").alias("_old")).filter("_old <> ''").distinct()
    return kept.join(newer, F.translate(F.col(path), "\\", "/") == F.col("_old"), "left_anti")
