"""Operator 9: toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.batches import map_batches, slices, trim
from lodeweave.llm.crf import Crf, padded

#: Labelled documents that the model is fitted on, at most: toxic ones and others.
TOXIC_ROWS, OTHER_ROWS, FOLDS = 1200, 2400, 5
#: A word or prefix marks its tokens in toxic documents if so many of those have it, at such odds.
LEAST_DOCS, LEAST_ODDS, PREFIXES = 3, 8.0, (5, 6, 7, 8)
#: Tokens on either side of a telling one; further away, a chain has forgotten it.
AROUND, PLAIN, TOXIC = 12, 0, 1
#: The field is fitted on at most so many chains of so many tokens around telling ones.
CHAINS, CHAIN = 5000, 24
WORD = re.compile(r"\w+")
#: Words whose odds a worker remembers, at most, until its partition ends.
REMEMBERED = 50_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no rest of FOLDS; a null id counts as ""."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def clues(word: str) -> list[str]:
    """A word and its longer beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def documents_with(texts: Iterable[list[str]], only: dict[str, int] | None) -> Counter:
    """How many of texts (lists of words) have each clue, of those in only if given."""
    found: Counter = Counter()
    for own in texts:
        found.update({c for w in set(own) for c in clues(w) if only is None or c in only})
    return found


class Factors(dict):
    """Word to the odds that its clues alone give for toxic; 0 without a clue. Filled as words are met."""

    def __init__(self, telling: dict[str, int], gain: np.ndarray):
        self.telling, self.gain = telling, gain

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        ids = [i for c in clues(word) if (i := self.telling.get(c))]
        got = self[word] = float(np.exp(self.gain[ids].sum())) if ids else 0.0
        return got


def tokens(text: str) -> list[str]:
    """The words of text in lower case, one for each WORD of text itself."""
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low)
    return [w.lower() for w in WORD.findall(text)]  # a letter that becomes several must not part its word


class Model:
    """Clues with their odds, the field over them, and the score's coefficients.

    Without a labelled toxic and a labelled other document nothing tells them apart: every score is 0.
    """

    def __init__(self, texts: list[str], toxic: list[int], seed: int = 3):
        same: dict[str, str] = {}  # a word met again is the word kept
        words = [[same.setdefault(w, w) for w in tokens(t or "")] for t in texts]
        n = [max(1, toxic.count(y)) for y in (0, 1)]
        have = documents_with((own for own, y in zip(words, toxic) if y == 1), None)
        have = {c: k for c, k in have.items() if k >= LEAST_DOCS}
        other = documents_with((own for own, y in zip(words, toxic) if y == 0), have)
        odds = lambda c: (have[c] + 0.5) / (n[1] + 1) / ((other[c] + 0.5) / (n[0] + 1))
        self.telling = {c: i + 2 for i, c in enumerate(sorted(c for c in have if odds(c) >= LEAST_ODDS))}
        self.names = len(self.telling) + 2  # 0 padding, 1 bias
        memo: dict[str, list[int]] = {}
        for w in same:
            if ids := [i for c in clues(w) if (i := self.telling.get(c))]:
                memo[w] = ids
        del have, other, same
        cells = []
        for own, y in zip(words, toxic):
            marked = [i for i, w in enumerate(own) if w in memo]
            for low, high in self.windows(marked, len(own), 3):
                cells += [(own, a, min(high, a + CHAIN), y) for a in range(low, high, CHAIN)]
        if len(cells) > CHAINS:
            cells = [cells[i] for i in np.random.default_rng(seed).choice(len(cells), CHAINS, replace=False)]
        self.crf = Crf(self.names + 2, 2)
        if cells:
            rows = [self.features(own, low, high, memo) for own, low, high, _ in cells]
            ids, lengths = padded(rows, max(len(f) for r in rows for f in r))
            gold = np.zeros(ids.shape[:2], dtype=int)
            for i, (own, low, high, y) in enumerate(cells):
                gold[i, : high - low] = [TOXIC if y and w in memo else PLAIN for w in own[low:high]]
            self.crf.fit(ids, gold, lengths, rounds=40)
        gain = self.crf.weight[:, TOXIC] - self.crf.weight[:, PLAIN]
        self.known = Factors(self.telling, gain)
        self.bias, self.left, self.right = (float(np.exp(gain[i])) for i in (1, self.names, self.names + 1))
        self.m = tuple(float(x) for x in np.exp(self.crf.move).ravel())
        self.begin = float(np.exp(self.crf.start[TOXIC] - self.crf.start[PLAIN]))
        m00, m01, m10, m11 = self.m
        self.before = self.after = 1.0
        for _ in range(300):  # odds that travel along an endless run of plain words
            self.before = self.bias * (self.before * m11 + m01) / (self.before * m10 + m00)
            self.after = (m11 * self.bias * self.after + m10) / (m01 * self.bias * self.after + m00)
        rest = self.before * self.after
        self.floor = rest / (1 + rest)
        x = np.array([self.evidence(w)[0] for w in words]) if words else np.zeros((0, 3))
        self.usable = 0 < sum(toxic) < len(toxic)
        self.scale = logistic(np.hstack([x, np.ones((len(x), 1))]), np.array(toxic, dtype=float)).tolist()
        self.known.clear()  # the fit's words: neither the driver nor the model sent out keeps them

    @staticmethod
    def windows(marked: list[int], n: int, around: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i in marked:
            low, high = max(0, i - around), min(n, i + around + 1)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def features(self, own: list[str], low: int, high: int, memo: dict[str, list[int]]) -> list[list[int]]:
        """Bias, the token's clues, and whether the neighbours have any."""
        k, none = self.names, []
        return [[1, *memo.get(own[i], none), *([k] if i and own[i - 1] in memo else none), *([k + 1] if i + 1 < len(own) and own[i + 1] in memo else none)] for i in range(low, high)]

    def marginals(self, own: list[str], low: int, high: int) -> list[float]:
        """Forward-backward over own[low:high] in odds of the two states; beyond lie plain words or the text's ends."""
        known, bias, (m00, m01, m10, m11) = self.known, self.bias, self.m
        odds = []
        for i in range(low, high):
            e = bias * (known[own[i]] or 1.0)
            if i and known[own[i - 1]]:
                e *= self.left
            if i + 1 < len(own) and known[own[i + 1]]:
                e *= self.right
            odds.append(e)
        a = [0.0] * len(odds)
        x = self.before
        for j, e in enumerate(odds):
            x = a[j] = e * self.begin if low + j == 0 else e * (x * m11 + m01) / (x * m10 + m00)
        y = self.after if high < len(own) else 1.0
        for j in range(len(odds) - 1, -1, -1):
            x = a[j] * y
            a[j] = x / (1 + x)
            x = odds[j] * y
            y = (m11 * x + m10) / (m01 * x + m00)
        return a

    def evidence(self, own: list[str]) -> tuple[list[float], list[int]]:
        """Marginals gathered: largest, log of 1 + sum, sum per root of length; and the toxic tokens.

        Runs of words without a clue, far from any, have the marginal of an endless plain run.
        """
        known = self.known
        marked = [i for i, w in enumerate(own) if known[w]]
        top, total, toxic = self.floor if own else 0.0, 0.0, []
        for low, high in self.windows(marked, len(own), AROUND):
            for j, p in enumerate(self.marginals(own, low, high)):
                if p > top:
                    top = p
                if p > 0.1:
                    total += p
                if p >= 0.5:
                    toxic.append(low + j)
        return [top, math.log1p(total), total / math.sqrt(len(own) + 1.0)], toxic

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """The document's score and its offending offsets, in code points."""
        if not self.usable:
            return 0.0, []
        own = tokens(text)
        x, toxic = self.evidence(own)
        z = sum(w * v for w, v in zip(self.scale, [*x, 1.0]))
        value = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        if not toxic:
            return value, []
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        return value, [at[i] for i in toxic]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """The model from at most toxic_rows + other_rows labelled documents outside the held-out fold, chosen by a hash of their id.

    Labels that are null or neither 0 nor 1, of a null id or of no document count for nothing; of several
    labels of one document the largest holds, of several texts any one. Null texts count as empty.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic, other = (usable.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, toxic_rows), (0, other_rows)))
    kind = docs.schema["doc_id"].dataType
    some = F.broadcast(toxic.union(other).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("y").cast("int").alias("y")))  # bounded by the two parameters
    rows = docs.select("doc_id", "text").join(some, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    model = Model([r["text"] or "" for r in rows], [r["y"] for r in rows])
    del rows
    trim()  # the driver goes on with other steps
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans ("start:end" of toxic tokens, comma-joined) of every whole text.

    Null and empty texts get the score of no words at all. Repeated rows each give their row; nothing but
    the text is an input of the score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                got = [own.score(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([",".join(f"{a}:{b}" for a, b in x) for _, x in got], pa.string())], names=["doc_id", "score", "spans"])
        own.known.clear()

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, spans string")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, as they are.

    Null and empty texts have the score of no words; repeated rows and rows without an id are judged each.
    A model without usable labels keeps every row; an empty table stays empty.
    """
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([own.score(t or "")[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))
        own.known.clear()

    return map_batches(docs, work, docs.schema)


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    made = score(docs, fit(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
