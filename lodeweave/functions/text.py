"""Text analysis as column expressions: tokens, entities, dates, tags, intents, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no token of any analyzer.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might this that these those it its as not no so if then than more"
).split()
#: Further words that the English analyzer leaves out.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself they them "
    "their theirs themselves what which who whom am about against between into through during before after above below up down "
    "out off over under again further once here there when where why how all any both each few most other some such nor only own "
    "same too very can just now also onto upon via"
).split()
#: Words of a query that name a kind of document.
DOC_TYPES = ("meeting", "decision", "adr", "incident", "note", "standup", "retro", "review", "report", "proposal", "rfc", "spec", "postmortem")
#: Patterns of queries that ask for facts, and of those that ask for prose.
GRAPH_CUES = (
    r"\b(who is|who are|who was|who were)\b",
    r"\b(what is|what are|what was|what were)\b.{0,40}\b(role|position|title|status|owner|lead)\b",
    r"\b(when did|when was|when is|when were)\b",
    r"\b(where is|where was|where does|where did)\b",
    r"\b(list|enumerate|show).{0,20}\b(all|every|each)\b",
    r"\b(relationship|connection|link|association).{0,20}\bbetween\b",
    r"\bfacts?\b.{0,20}\babout\b",
    r"\btell me about\b",
    r"\bwhat.{0,20}\bknow.{0,20}\babout\b",
    r"\b(owned by|managed by|led by|created by|built by|reported to)\b",
    r"\bwho\b.{0,30}\b(owns|manages|leads|created|built|reports to)\b",
    r"\b(timeline|history|record|log)\b.{0,20}\bof\b",
)
LEXICAL_CUES = (
    r"\b(how does|how do|how to|how can|how should|how would)\b",
    r"\b(explain|describe|summarize|overview|walkthrough|elaborate)\b",
    r"\b(process|procedure|workflow|pipeline|steps?|guide|tutorial)\b",
    r"\b(what happened|incident|outage|failure|error|bug)\b",
    r"\b(difference between|compare|versus|vs\.?|contrast)\b",
    r"\b(why|reason|cause|because)\b",
    r"\b(example|sample|instance|demo|illustration)\b",
    r"\brecent(ly)?\b",
    r"\b(architecture|design|structure|pattern)\b",
    r"\b(document|note|file|page|article)\b.{0,20}\babout\b",
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda takes from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, english: bool = False) -> Column:
    """Lower-case runs of letters, digits and underscores, without stop words and single characters."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    stop = STOPWORDS + ENGLISH if english else STOPWORDS
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def n_words(text: Column) -> Column:
    """Number of words parted by white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    return F.floor(n_words(text) * F.lit(1.3)).cast("long")


def _whole_words(text: Column) -> Column:
    """Runs of letters, digits and underscores: word boundaries that do not hang on an engine's idea of them."""
    return F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+")


def surface_entities(text: Column, most: int = 20) -> Column:
    """Quoted phrases, then capitalised words, in order of first appearance."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{3,40})"'), F.lit(1))
    names = F.filter(_whole_words(text), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))
    return F.slice(F.array_distinct(F.concat(quoted, names)), 1, most)


def query_entities(text: Column) -> Column:
    """Quoted phrases, double before single quotes, then capitalised words, then tokens of more than four letters."""
    quoted = F.concat(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1)))
    names = F.filter(_whole_words(text), lambda w: w.rlike("^[A-Z][a-zA-Z]{2,}$"))
    return F.array_distinct(F.concat(quoted, names, F.filter(tokens(text), lambda t: F.length(t) > 4)))


def links(text: Column) -> Column:
    """Targets of wiki links, then of Markdown links, trimmed, duplicates kept."""
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    every = F.concat(wiki, F.regexp_extract_all(text, F.lit(r"\[(?:[^\]]+)\]\(([^)#)]+)\)"), F.lit(1)))
    return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")


def intent(text: Column) -> Column:
    """Which of two cue lists matches more often."""
    low = F.lower(text)
    graph, lexical = (sum((F.when(low.rlike(p), 1).otherwise(0) for p in cues), F.lit(0)) for cues in (GRAPH_CUES, LEXICAL_CUES))
    return F.when(graph > lexical, "kg_first").when(lexical > graph, "bm25_first").otherwise("balanced")


def date_range(text: Column) -> tuple[Column, Column]:
    """First and last day that a query's quarter or year names, as ISO strings; a quarter ends on day 31 whatever its month."""
    named = r"(?i)\bQ([1-4])\s*(\d{4})\b"
    quarter, q_year = F.regexp_extract(text, named, 1), F.regexp_extract(text, named, 2)
    number = F.regexp_extract(text, r"\b(\d{4})\b", 1)  # only the first number of four digits counts
    year = F.when(number.try_cast("int").between(1990, 2099), number)
    first = F.lpad(((quarter.try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0")
    last = F.lpad((quarter.try_cast("int") * 3).cast("string"), 2, "0")
    low = F.when(quarter != "", F.concat(q_year, F.lit("-"), first, F.lit("-01"))).when(year.isNotNull(), F.concat(year, F.lit("-01-01")))
    high = F.when(quarter != "", F.concat(q_year, F.lit("-"), last, F.lit("-31"))).when(year.isNotNull(), F.concat(year, F.lit("-12-31")))
    return low, high


def query_tags(text: Column) -> Column:
    """Tags that a query names: #tag, tagged tag, about a word of four letters or more; lower case, in that order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"#(\w+)", r"(?i)\btagged\s+(\w+)", r"(?i)\babout\s+(\w{4,})\b")]
    return F.transform(F.concat(*found), lambda t: F.lower(t))


def query_type(text: Column) -> Column:
    """The kind of document that a query names first; null without one."""
    low = F.lower(text)
    at = [F.struct(F.char_length(F.regexp_extract(low, rf"(?s)^(.*?)\b{t}\b", 1)).alias("at"), F.lit(t).alias("name")) for t in DOC_TYPES]
    named = F.array(*(F.when(low.rlike(rf"\b{t}\b"), s) for t, s in zip(DOC_TYPES, at)))
    return F.array_min(F.filter(named, lambda x: x.isNotNull()))["name"]


def tag_set(raw: Column) -> Column:
    """Tags of a front matter value (a, b or [a, b] or #a #b) in lower case, each once."""
    items = F.split(F.regexp_replace(F.trim(raw), r"^[\[\]]+|[\[\]]+$", ""), r"[,\s]+")
    bare = F.transform(items, lambda t: F.lower(F.regexp_replace(t, r"""^['"#]+|['"#]+$""", "")))
    return F.coalesce(F.array_distinct(F.filter(bare, lambda t: t != "")), F.array().cast("array<string>"))


def tag_overlap(doc_tags: Column, asked: Column) -> Column:
    """Share of the asked tags that a document's tag field holds; 0 without either."""
    have = F.split(F.lower(doc_tags), r"[\s,;]+")
    hits = F.size(F.filter(asked, lambda t: F.array_contains(have, t)))
    return F.when((F.coalesce(doc_tags, F.lit("")) == "") | (F.size(asked) == 0), 0.0).otherwise(hits / F.size(asked))


def iso_date(value: Column) -> Column:
    """The ISO date that a value begins with, of year, month or day precision; null without one."""
    bare = F.regexp_replace(F.trim(value), r"""^['"]+|['"]+$""", "")
    found = F.regexp_extract(bare, r"^(\d{4}(-\d{2}(-\d{2})?)?)", 1)
    return F.when(found != "", found)


def document_date(value: Column) -> Column:
    """The day that a value begins with (YYYY-MM-DD or YYYY/MM/DD); null where there is none or it does not exist."""
    bare = F.regexp_replace(F.trim(value), r"""^['"]+|['"]+$""", "")
    year, month, day = (F.regexp_extract(bare, r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})", g) for g in (1, 3, 4))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).try_cast("date")


#: Numbers in words, days of a unit of time and how far about it a reference reaches.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "a couple of": 2, "couple of": 2, "a few": 3, "few": 3}
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
REACH = {"day": 1, "week": 3, "month": 10, "year": 45}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Windows of more days are none.
WIDEST = 45


def time_windows(text: Column, reference: Column) -> Column:
    """Windows (low, high) of days that a query's points in time name, seen from reference; both ends belong to them."""

    def looked_up(values: dict[str, int], key: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)

    def days(centre: Column, before: Column, after: Column) -> Column:
        return F.struct(F.date_sub(centre, before.cast("int")).alias("low"), F.date_add(centre, after.cast("int")).alias("high"))

    def found(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group))

    ago = r"\b(\d+|a couple of|couple of|a few|few|an|a|one|two|three|four|five|six|seven|eight|nine|ten)\s+(day|week|month|year)s?\s+ago\b"
    named = F.zip_with(found(ago, 1), found(ago, 2), lambda n, u: F.struct(F.coalesce(looked_up(NUMBERS, n), n.try_cast("int")).alias("n"), u.alias("u")))
    named = F.filter(named, lambda x: x["n"].isNotNull() & (x["n"] < 700_000))

    def about(x: Column) -> Column:
        reach = looked_up(REACH, x["u"])
        wide = F.least(reach * F.when(x["u"] == "day", 1).otherwise(x["n"]), 2 * reach)
        return days(F.date_sub(reference, (x["n"] * looked_up(UNITS, x["u"])).cast("int")), wide, wide)

    def last(day: Column) -> Column:  # the latest such day before reference
        back = F.pmod(F.weekday(reference) - day, F.lit(7))
        return F.date_sub(reference, F.when(back == 0, 7).otherwise(back))

    weekday = F.transform(found(r"\blast\s+(" + "|".join(WEEKDAYS) + r")\b", 1), lambda d: days(last(F.array_position(F.array(*map(F.lit, WEEKDAYS)), d).cast("int") - 1), F.lit(1), F.lit(1)))
    low = F.lower(text)
    once = [(r"\byesterday\b", days(reference, F.lit(2), F.lit(0))), (r"\blast\s+weekend\b", days(last(F.lit(5)), F.lit(1), F.lit(2))), (r"\blast\s+week\b", days(reference, F.lit(11), F.lit(-3))), (r"\blast\s+month\b", days(reference, F.lit(45), F.lit(-15)))]
    some = F.filter(F.array(*(F.when(low.rlike(p), w) for p, w in once)), lambda w: w.isNotNull())
    every = F.concat(F.transform(named, about), weekday, some)
    return F.filter(every, lambda w: F.datediff(w["high"], w["low"]) <= WIDEST)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Structs (start, content) of word windows; those that the tail covers again are kept."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(max(1, size - overlap)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s + 1, size), " ").alias("content")))


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.85 for one inside the other, else shared words over the larger number; case and outer spaces are ignored."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    wx, wy = (F.array_distinct(F.filter(F.split(v, r"\s+"), lambda w: w != "")) for v in (x, y))
    shared = F.size(F.array_intersect(wx, wy)) / F.nullif(F.greatest(F.size(wx), F.size(wy)), F.lit(0))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.85).otherwise(F.coalesce(shared, F.lit(0.0)))


def dense_windows(words: Column, size: int = 200, stride: int = 150) -> Column:
    """Structs (start, content) of the windows that a document is embedded by: one if it is short, and no tail that the last one covers."""
    n = F.size(words)
    starts = F.when(n > size, F.sequence(F.lit(0), F.greatest(F.lit(1), n - (size - stride)) - 1, F.lit(stride))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s + 1, size), " ").alias("content")))


def bounded_windows(text: Column, size: int, overlap: int, lines: bool = False) -> Column:
    """Structs (start, end, low, high) of word windows: their words, and their characters in the text itself.

    With lines a window that is not the last ends at the last line break in its second half, if there is one, and the next
    starts overlap words before that end, or one word on. So each start hangs on the end before: a fold over the
    words carries start and character together, and no word is looked at twice. A null text, and one of white space, has none.
    """
    body = F.coalesce(text, F.lit(""))
    lead = F.char_length(F.regexp_extract(body, r"^\s*", 0))
    return let(F.struct(lead.alias("lead"), F.regexp_extract_all(body, F.lit(r"\S+\s*"), F.lit(0)).alias("words")), lambda t: _windows(t["lead"], t["words"], size, overlap, lines))


def _windows(lead: Column, words: Column, size: int, overlap: int, lines: bool) -> Column:
    n = F.size(words)
    number = lambda c: c.cast("int")
    breaks = F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit("\n")) & (i < n - 1), i + 1)), lambda i: i.isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,low:int,high:int>>")
    first = F.struct(number(F.lit(0)).alias("start"), number(lead).alias("at"), none.alias("out"))

    def step(state: Column, own_breaks: Column) -> Column:
        start = state["start"]
        full = F.least(start + size, n)
        last = F.array_max(F.filter(own_breaks, lambda b: (b >= start + max(1, size // 2)) & (b <= full))) if lines else F.lit(None).cast("int")
        end = F.when(full < n, F.coalesce(last, full)).otherwise(full)
        after = F.greatest(start + 1, end - overlap) if lines else start + max(1, size - overlap)
        done = (end >= n) if lines else (after >= n)
        own = F.regexp_replace(F.array_join(F.slice(words, start + 1, end - start), ""), r"\s+$", "")
        window = F.struct(number(start).alias("start"), number(end).alias("end"), number(state["at"]).alias("low"), number(state["at"] + F.char_length(own)).alias("high"))
        moved = state["at"] + F.char_length(F.array_join(F.slice(words, start + 1, after - start), ""))
        return F.struct(number(F.when(done, F.lit(None)).otherwise(after)).alias("start"), number(moved).alias("at"), F.concat(state["out"], F.array(window)).alias("out"))

    def fold(own_breaks: Column) -> Column:
        each = lambda state, _: F.when(state["start"].isNull(), state).otherwise(step(state, own_breaks))
        return F.aggregate(F.sequence(F.lit(1), n), first, each, lambda state: state["out"])

    return F.when(n > 0, let(breaks, fold)).otherwise(none)


def merged_spans(spans: Column) -> Column:
    """The union of spans (low, high) as spans in order that neither meet nor touch."""
    none = F.array().cast("array<struct<low:int,high:int>>")
    one = lambda low, high: F.array(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")))

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), one(last["low"], F.greatest(last["high"], s["high"])))
        return F.when((F.size(out) > 0) & (s["low"] <= last["high"]), joined).otherwise(F.concat(out, one(s["low"], s["high"])))

    return F.aggregate(F.array_sort(spans), none, step)
