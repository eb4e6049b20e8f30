"""Facts that a Markdown text states: relations in its prose, links and tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no entity.
NO_ENTITY = (
    "this that these those it they he she we you i there here what which who the a an "
    "its their his her our your my any each all"
).split()
#: Relations by the words that stand between subject and object; the object begins with any letter or with a capital.
RELATIONS = (
    ("is_a", r"is\s+(?:a|an|the)\s+", "any"),
    ("is", r"is\s+", "capital"),
    ("works_at", r"works?\s+(?:at|for)\s+", "capital"),
    ("leads", r"(?:leads?|led)\s+(?:the\s+)?", "any"),
    ("owns", r"(?:owns?|owned)\s+(?:the\s+)?", "any"),
    ("created", r"(?:created?|built|developed|authored|wrote)\s+(?:the\s+)?", "capital"),
    ("reports_to", r"reports?\s+to\s+", "capital"),
    ("part_of", r"is\s+part\s+of\s+(?:the\s+)?", "capital"),
    ("replaced", r"replaced?\s+(?:the\s+)?", "capital"),
    ("uses", r"uses?\s+(?:the\s+)?", "capital"),
    ("depends_on", r"depends?\s+on\s+(?:the\s+)?", "capital"),
    ("responsible_for", r"is\s+responsible\s+for\s+", "any"),
    ("managed_by", r"is\s+(?:managed|owned|led|run)\s+by\s+", "capital"),
    ("introduced", r"introduced\s+(?:the\s+)?", "capital"),
)
SUBJECT = r"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)"
OBJECT = {"any": r"([A-Za-z][^,.!?\n]{1,55})", "capital": r"([A-Z][A-Za-z][^,.!?\n]{1,55})"}
SENTENCE_WORDS, FACTS = 40, 60


def _triple(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"))


def prose(text: Column) -> Column:
    """The first FACTS relations that a text states, by sentence, relation and place; sentences of more than SENTENCE_WORDS words are passed over.

    A null or empty text states none. Names have 2 to 60 characters, are no pronoun and no number.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|[,;.!?\s]+$", "")
    name = lambda c: F.char_length(c).between(2, 60) & ~F.lower(c).isin(NO_ENTITY) & ~c.rlike(r"^\d+$")

    def of(sentence: Column) -> Column:
        found = []
        for predicate, between, kind in RELATIONS:
            pattern = F.lit(SUBJECT + r"\s+" + between + OBJECT[kind])
            sides = [F.regexp_extract_all(sentence, pattern, F.lit(g)) for g in (1, 2)]
            named = F.lit(predicate)
            found.append(F.zip_with(*sides, lambda s, o: _triple(bare(s), named, bare(o))))  # noqa: B023  called at once
        return F.filter(F.flatten(F.array(*found)), lambda t: name(t["subject"]) & name(t["object"]))

    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    short = F.filter(sentences, lambda s: F.size(F.split(F.trim(s), r"\s+")) <= SENTENCE_WORDS)
    return F.slice(F.flatten(F.transform(short, of)), 1, FACTS)


def marked(text: Column, source: Column) -> Column:
    """(entity, mentioned_in, source) of each wiki link, then (source, tagged_as, tag) of each tag."""
    text = F.coalesce(text, F.lit(""))
    links = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.substring_index(x, "|", 1)))
    mentions = F.transform(F.filter(links, lambda x: x != ""), lambda x: _triple(x, F.lit("mentioned_in"), source))
    tags = F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_/-]+)"), F.lit(1))
    return F.concat(mentions, F.transform(tags, lambda x: _triple(source, F.lit("tagged_as"), x)))


def asks_advice(query: Column) -> Column:
    """Whether a query asks for advice."""
    return F.coalesce(query, F.lit("")).rlike(r"(?i)\b(recommend|recommendations?|suggest|suggestions?|tips|ideas|advice|any thoughts)\b")


def confidence(best: Column) -> Column:
    """How far the best score of a result can be trusted: empty, low (under 0.005) or ok."""
    return F.when(best.isNull(), "empty").when(best < 0.005, "low").otherwise("ok")


def query_hash(query: Column) -> Column:
    """A key of a query, whatever its case and outer blanks."""
    return F.substring(F.sha2(F.trim(F.lower(query)), 256), 1, 16)
