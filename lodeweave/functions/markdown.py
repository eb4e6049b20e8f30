"""Markdown documents as column expressions: front matter, sections and their heading paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import let

HEADING = r"^#{1,6}\s+."


def front_matter(text: Column) -> Column:
    """Struct (meta, body): the lines "key: value" between --- marks that a text begins with, the last of equal keys, and what follows.

    Without an opening or a closing mark meta is empty and body the whole text; a null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    end = F.when(F.startswith(text, F.lit("---")), F.locate("\n---", text, 4)).otherwise(0)
    block = F.when(end > 0, F.substr(text, F.lit(4), end - 4)).otherwise("")
    lines = F.filter(F.split(block, r"\R"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.locate(":", x) + 1)).alias("value")))
    last = let(pairs, lambda own: F.filter(own, lambda p, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda q: q["key"] == p["key"])))
    body = F.when(end > 0, F.trim(F.regexp_replace(F.substr(text, end + 4), r"^\s+|\s+$", ""))).otherwise(text)
    return F.struct(F.map_from_entries(last).alias("meta"), body.alias("body"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(body: Column) -> Column:
    """Structs (heading, path, content, whole) in order: one for each heading, and one for text before the first.

    path holds the headings above a section and its own, whole its heading and content; sections without
    both are left out. A body without a heading is one section of no heading.
    """
    return let(F.split(body, r"\R"), _sections)


def _sections(lines: Column) -> Column:
    n = F.size(lines)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, i).rlike(HEADING))
    heads = F.transform(at, lambda i: F.struct(i.alias("line"), F.char_length(F.regexp_extract(F.get(lines, i), "^(#+)", 1)).alias("level"), stripped(F.regexp_replace(F.get(lines, i), r"^#{1,6}\s+", "")).alias("heading")))

    return let(heads, lambda own: _between(lines, own))


def _between(lines: Column, heads: Column) -> Column:
    n = F.size(lines)

    def lines_between(low: Column, high: Column) -> Column:
        return stripped(F.array_join(F.slice(lines, low + 1, F.greatest(F.lit(0), high - low)), "\n"))

    def one(head: Column, k: Column) -> Column:
        above = F.filter(heads, lambda h, j: (j < k) & (h["level"] < F.array_min(F.transform(F.slice(heads, j + 2, k - j), lambda x: x["level"]))))
        content = lines_between(head["line"] + 1, F.coalesce(F.get(heads, k + 1)["line"], n))
        path = F.concat(F.transform(above, lambda h: h["heading"]), F.array(head["heading"]))
        return F.struct(head["heading"].alias("heading"), path.alias("path"), content.alias("content"), stripped(F.concat(head["heading"], F.lit("\n\n"), content)).alias("whole"))

    first = lines_between(F.lit(0), F.coalesce(F.get(heads, F.lit(0))["line"], n))
    opening = F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("path"), first.alias("content"), first.alias("whole"))
    return F.filter(F.concat(F.array(opening), F.transform(heads, one)), lambda s: (s["heading"] != "") | (s["content"] != ""))
