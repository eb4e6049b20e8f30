"""Operator 7: chat formatting by rotating the perspective through a conversation's participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.ranking import ranked
from lodeweave.session import stored

#: Turns of one row of a rendering; that of a longer conversation has several.
TURNS = 512


def named(role):
    """A role as it stands in a mark: with nothing that could end or forge one."""
    return F.translate(F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), "\n\r", "  ")


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """Each part of each conversation, once for every participant of the whole conversation.

    A participant's parts in order make up their rendering of all turns. Returns conv_id, part (from 0, of turns turns), speaker, n_turns, n_masked, text and masks. text has
    the speaker's turns as <|assistant|>, the others' as <|user name=...|> and those of the role system as
    <|system|>; masks ("start:end", code points of the whole rendering, comma-joined) holds the spans to
    be learned: the speaker's words and end marks, none in a part where they say nothing. "<|" inside a turn or a role becomes "< |", "|>" and line ends
    inside a role become "| >" and spaces, so that neither can forge a mark.

    Turns go by turn, role and text, null turns first. A null role is the participant "", a null text is
    empty, null conv_ids are one conversation. Conversations of system turns alone have no participant
    and no row. A conversation of any length is ranked over all partitions and rendered in parts, so that
    a task holds at most turns turns at a time. An empty table gives an empty result; other columns are not looked at.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce("conv_id", F.lit("" if kind == "string" else 0).cast(kind)).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("words")]
    rows = ranked(stored(rows, "turns"), ["none", "conv"], order)
    rows = stored(rows.withColumn("part", F.floor((F.col("rank") - 1) / turns).cast("int")), "ranked")
    keys = ["none", "conv", "part"]
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "role", "words"))).alias("t"))
    speakers = rows.filter("role <> 'system'").select("none", "conv", F.col("role").alias("speaker")).distinct()
    last = rows.groupBy("none", "conv").agg(F.max("part").alias("last"))
    # dealt by part, so that a long conversation spans many partitions
    views = speakers.join(last, ["none", "conv"]).select("none", "conv", "speaker", F.explode(F.sequence(F.lit(0), "last")).alias("part"))

    def head(role):
        user = F.concat(F.lit("<|user name="), named(role), F.lit("|>\n"))
        return F.when(role == F.col("speaker"), F.lit("<|assistant|>\n")).when(role == "system", F.lit("<|system|>\n")).otherwise(user)

    # a turn's code points do not depend on the view but for the head of the speaker's own
    chars = F.char_length(F.concat(F.when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), named(F.col("role")), F.lit("|>\n"))), "words", F.lit("<|end|>\n")))
    by_role = stored(rows.groupBy(*keys, "role").agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("own")), "lengths")
    whole = by_role.groupBy(*keys).agg(F.sum("chars").alias("chars"))
    own = by_role.select(*keys, F.col("role").alias("speaker"), "own")
    less = F.coalesce("own", F.lit(0)) * F.char_length(F.concat(F.lit("<|user name="), named(F.col("speaker")), F.lit("|>\n")))
    more = F.coalesce("own", F.lit(0)) * F.char_length(F.lit("<|assistant|>\n"))
    views = views.join(own, [*keys, "speaker"], "left").join(whole, keys).withColumn("size", F.col("chars") - less + more)
    earlier = Window.partitionBy("none", "conv", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    views = stored(views.select(*keys, "speaker", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")), "views")
    seen = parts.join(views, keys)
    pieces = F.transform("t", lambda x: F.struct((x["role"] == F.col("speaker")).alias("own"), head(x["role"]).alias("head"), F.concat(x["words"], F.lit("<|end|>")).alias("body")))
    seen = seen.withColumn("p", pieces)
    start = F.struct(F.col("before").alias("at"), F.lit("").alias("masks"))

    def step(s, x):
        low = s["at"] + F.char_length(x["head"])
        high = low + F.char_length(x["body"])
        span = F.concat(s["masks"], F.when(s["masks"] == "", F.lit("")).otherwise(F.lit(",")), low.cast("string"), F.lit(":"), high.cast("string"))
        return F.struct((high + 1).alias("at"), F.when(x["own"], span).otherwise(s["masks"]).alias("masks"))

    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return seen.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        "part",
        "speaker",
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_masked"),
        text.alias("text"),
        F.aggregate("p", start, step)["masks"].alias("masks"),
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return made.select("conv_id", "part", "speaker", "n_turns", "n_masked", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "masks")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), replace(coalesce(text, ''), '<|', '< |')) - 1 AS rn
  FROM conversations),
s AS (SELECT conv_id, role AS speaker, row_number() OVER () AS view FROM (SELECT DISTINCT conv_id, role FROM t WHERE role <> 'system')),
r AS (
  SELECT t.conv_id, s.speaker, s.view, t.rn, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || translate(replace(replace(t.role, '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' || chr(10) END AS head,
         t.words || '<|end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY view ORDER BY rn) - length(body) - 1 AS low FROM r)
-- a rendering is stored in parts of so many turns; its masks count from its own start
SELECT conv_id, CAST(rn // {turns} AS INTEGER) AS part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
       CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
       sha256(string_agg(head || body || chr(10), '' ORDER BY rn)) AS text_sha256,
       coalesce(string_agg(CAST(low AS BIGINT) || ':' || CAST(low + length(body) AS BIGINT), ',' ORDER BY rn) FILTER (own), '') AS masks
FROM o GROUP BY conv_id, rn // {turns}, speaker, view
""".replace("{turns}", str(TURNS))
