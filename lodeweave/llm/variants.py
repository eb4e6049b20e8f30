"""Operator 12: spelling variants by two-dimensional range reporting over wavelet trees."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.batches import map_batches, slices
from lodeweave.session import dropped, stored

#: A run of letters loses a letter if this divides its hash; words have so many letters and occurrences at least.
EVERY, LETTERS, OCCURRENCES = 199, 6, 5
#: A form occurs so many times as often as the word that it stands for.
TIMES = 5
#: Words of a block, and visitors of a block for each copy of it.
BLOCK, VISITORS = 16_384, 65_536
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Greater than any letter of a word.
_TOP = "\U0010ffff"
#: Latin-1 in which A-Z are lower-cased and all but A-Z, a-z and À-ÿ are spaces.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def occurrences(doc_id: str, text: str, every: int = EVERY) -> Iterator[tuple[bytes, int]]:
    """Words (Latin-1) of LETTERS letters or more after the letters taken out, with their number; a word may come twice."""
    runs = text.encode("latin-1", "replace").translate(_RUNS).split()
    before = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter([r for r in runs if len(r) >= LETTERS]).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LETTERS:
                continue
        yield run, n


def words(docs: DataFrame, every: int = EVERY, least: int = OCCURRENCES) -> DataFrame:
    """word, n: the words of whole texts that occur least times or more.

    A run of letters A-Z, a-z, \\u00C0-\\u00FF (A-Z lower-cased) loses its letter number h % length if every
    divides h, the crc32 of "id:run". Null texts have no words, a null id counts as "", repeated rows count
    each. Tasks count their own words first, HELD at a time. An empty table has no words; other columns are
    not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            some = list(held)
            for low in range(0, len(some), 20_000):
                own = some[low : low + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in own], pa.string()), pa.array([held[w] for w in own], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in occurrences(doc_id, text or "", every):
                        held[word] += n
                    if len(held) >= HELD:
                        yield from handed()
        yield from handed()

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    some = map_batches(docs.select(ids, "text"), count, "word string, n long", "words")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Wavelet:
    """A permutation as a wavelet tree whose levels lie side by side: each level splits the values by one bit, its zeros first."""

    def __init__(self, values: np.ndarray):
        self.bits, self.levels = max(1, int(len(values) - 1).bit_length()), []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[~one], values[one]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (rectangle, value) with the value's place in [low, high) and the value in [least, most), for arrays of rectangles."""
        which, value = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for bit, ones, zeros in self.levels:
            low1, high1 = ones[low], ones[high]
            low, high = np.concatenate([low - low1, low1 + zeros]), np.concatenate([high - high1, high1 + zeros])
            which, value = np.concatenate([which, which]), np.concatenate([value, value + (1 << bit)])
            live = (low < high) & (value < most[which]) & (value + (1 << bit) > least[which])
            low, high, which, value = low[live], high[live], which[live], value[live]
        return which, value


class Block:
    """Words in order of length and letters, crossed with their order from the last letter backwards."""

    def __init__(self, points: list[tuple[str, int]]):
        points = sorted(points, key=lambda p: (len(p[0]), p[0]))
        self.words, self.n = [w for w, _ in points], [n for _, n in points]
        backward = sorted(range(len(points)), key=lambda i: (len(self.words[i]), self.words[i][::-1]))
        self.at = np.array(backward, dtype=np.int64)
        self.back = [self.words[i][::-1] for i in backward]
        rank = np.empty(len(points), dtype=np.int64)
        rank[self.at] = np.arange(len(points))
        self.tree = Wavelet(rank)
        sizes = [len(w) for w in self.words]
        self.range = {m: (bisect_left(sizes, m), bisect_right(sizes, m)) for m in set(sizes)}

    def near(self, visitors: list[tuple[str, int]], mirrored: bool) -> Iterator[tuple[str, str, int]]:
        """(word, near word, its n) for words of the block that replace a letter of a visitor, or insert one, in its later half; both ways for the inserted.

        mirrored: block and visitors are written backwards, and the earlier half of the words, less what the
        later half covers, comes last.
        """
        rects: list[tuple[int, int, int, int, int, int, int]] = []
        for who, (x, _) in enumerate(visitors):
            m, r = len(x), x[::-1]
            first = m - m // 2 if mirrored else m // 2
            for size, cut, start in ((m, 1, first), (m + 1, 0, first + mirrored)):
                if size not in self.range:
                    continue
                floor, roof = low, high = self.range[size]
                for i in range(start, m + 1 - cut):
                    prefix = x[:i]
                    low = bisect_left(self.words, prefix, low, high)
                    high = bisect_left(self.words, prefix + _TOP, low, high)
                    if low == high or high - low == 1 and self.words[low] == x:
                        break
                    suffix = r[: m - i - cut]
                    a = bisect_left(self.back, suffix, floor, roof)
                    b = bisect_left(self.back, suffix + _TOP, a, roof)
                    if a < b:
                        rects.append((low, high, a, b, who, i, cut))
        if not rects:
            return
        low, high, a, b, whose, place, cuts = np.array(rects, dtype=np.int64).T
        which, value = self.tree.report(low, high, a, b)
        flip = (lambda w: w[::-1]) if mirrored else (lambda w: w)
        for who, i, cut, at in zip(whose[which].tolist(), place[which].tolist(), cuts[which].tolist(), self.at[value].tolist()):
            x, n = visitors[who]
            y = self.words[at]
            if cut:
                if y != x:
                    yield flip(x), flip(y), self.n[at]
            elif (i == 0 or y[i] != x[i - 1]) if mirrored else (i == len(x) or y[i] != x[i]):  # of a run of one letter, its last place in the word's own order
                yield flip(x), flip(y), self.n[at]
                yield flip(y), flip(x), n


def near_words(vocabulary: DataFrame, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """word, near, near_n: ordered pairs of words of vocabulary (word, n; each word once) that differ by one inserted, deleted or replaced letter, each once.

    For each place of a letter, the words with the same letters before it are an interval of the words in
    order, those with the same letters after it an interval of them in order from behind; a wavelet tree
    reports the words in both. Every word is dealt to a block of about `block` neighbours in either order, and visits
    the blocks that its first half reaches in that order: there it finds what differs in the other half, so a
    visit goes to one or two blocks however many words there are. A block with more than `visitors` visits has
    copies that share them. The driver gets the first word of each block.
    """
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.select("word", "n")
    blocks = max(1, math.ceil(vocabulary.count() / block))
    sides, starts = [], []
    for side in (0, 1):
        x = F.reverse("word") if side else F.col("word")
        own = vocabulary.select(F.lit(side).alias("side"), x.alias("x"), F.length("word").alias("size"), "n").repartitionByRange(blocks, "size", "x")
        own = stored(own.withColumn("block", F.spark_partition_id()), "block")
        starts.append(sorted((r["s"]["size"], r["s"]["x"], r["block"]) for r in own.groupBy("block").agg(F.min(F.struct("size", "x")).alias("s")).collect()))
        sides.append(own)
    points = sides[0].unionByName(sides[1])
    sent = spark.sparkContext.broadcast([([s[:2] for s in own], [s[2] for s in own]) for own in starts])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, x, n = (batch.column(i).to_pylist() for i in range(3))
            row, to = [], []
            for i, (s, w) in enumerate(zip(side, x)):
                bounds, ids = sent.value[s]
                m = len(w)
                prefix = w[: m - m // 2] if s else w[: m // 2]
                reached = set()
                for size in (m, m + 1):
                    low = max(0, bisect_right(bounds, (size, prefix)) - 1)
                    reached.update(range(low, bisect_right(bounds, (size, prefix + _TOP))))
                row += [i] * len(reached)
                to += [ids[k] for k in reached]
            taken = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(3)] + [pa.array(to, pa.int32())], names=["side", "x", "n", "block"])

    visits = stored(map_batches(points.select("side", "x", "n"), visit, "side int, x string, n long, block int", "visits"), "visits")
    copies = F.broadcast(visits.groupBy("side", "block").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("copies")))  # a row for each block
    come = visits.join(copies, ["side", "block"]).withColumns({"kind": F.lit(1), "copy": F.pmod(F.xxhash64("x"), F.col("copies")).cast("int")})
    stand = points.join(copies, ["side", "block"]).withColumns({"kind": F.lit(0), "copy": F.explode(F.sequence(F.lit(0), F.col("copies") - 1))})
    columns = ["side", "block", "copy", "kind", "x", "n"]
    met = stand.select(*columns).unionByName(come.select(*columns)).repartition("side", "block", "copy").sortWithinPartitions(*columns[:4])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            x, n = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(x)]
            for low, high in zip([0, *ends], ends):
                side, number, copy, kind = key[low].tolist()
                own = list(zip(x[low:high], n[low:high]))
                if (side, number, copy) != here:
                    here, held, index = (side, number, copy), [], None
                if kind == 0:
                    held += own
                    continue
                index = index or Block(held)
                found = list(index.near(own, side == 1))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    return map_batches(met, meet, "word string, near string, near_n long", "meet")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: forms (word, form) are followed to the last. A form occurs TIMES as often as its word, so no path returns; each round doubles the steps."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = stored(step, "roots")
        dropped(ways)
        ways = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return ways
        ways._stored_at = step._stored_at


def group(vocabulary: DataFrame, times: int = TIMES, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of vocabulary (word, n).

    A word's form is the near word of largest n (ties to the first in code-point order) if that is times n or
    more, else null; root is the last of the forms' forms, the word itself without a form. Words without a
    near word have n_near 0. An empty vocabulary gives an empty result.
    """
    vocabulary = stored(vocabulary, "vocabulary")
    near = near_words(vocabulary, **how)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    all_words = vocabulary.join(best, "word", "left")
    stands = -F.col("best.less") >= times * F.col("n")
    out = all_words.select(
        "word",
        F.when(stands, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, -F.col("best.less")).alias("form_n"),
    )
    out = stored(out, "forms")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
