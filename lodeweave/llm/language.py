"""Operator 11: language of every word of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.batches import kept, map_batches, slices, trim
from lodeweave.llm.crf import Crf, padded

#: The fit's bounds: languages (those of most documents), documents of each, stretches of a document and words of a stretch.
LANGS, DOCS, STRETCHES, STRETCH = 64, 300, 2, 60
#: Chains of so many words that the field is fitted on, and the words after which a chain goes on in another text, on average.
CHAINS, CHAIN, RUN, ROUNDS = 1500, 20, 8, 40
#: A clue counts if so many words of the fit have it; a word is in a language's lexicon if it came so often.
LEAST_CLUE, LEAST_WORD = 3, 2
#: Letters of a word that the fit looks at, at most: longer ones stay out of it.
LETTERS = 30
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Runs of letters and digits; those without a letter are no words, and those with a digit tell nothing of a language.
WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
#: Words whose scores a worker remembers, and words that are worked on together.
REMEMBERED, PIECE, SEGMENT = 300_000, 1 << 17, 64
#: Characters whose words are looked up together.
AT_ONCE = 1 << 20
_GAP = re.compile(r"[\W_]")
#: A word's least weight for a language, of a largest of 1: messages are scaled after every EVERY words.
LEAST, EVERY = 1e-12, 8


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves the rest HELD of FOLDS; a null id counts as ""."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def clues(word: str) -> set[str]:
    """Beginnings and ends of one to four letters, and runs of three with the word's ends marked."""
    marked = f"^{word}$"
    out = {marked[i : i + 3] for i in range(len(word))}
    for n in range(1, min(4, len(word)) + 1):
        out.add("<" + word[:n])
        out.add(">" + word[-n:])
    return out


class Model:
    """The languages, the clues' weights, the lexicons and the field's transitions."""

    def __init__(self, rows: list[tuple[str, list[str]]], seed: int = 11):
        """rows: language and words (lower case) of each text of the fit.

        Every other text of a language goes to the lexicons, the rest to the chains, so that a lexicon is
        as reliable for the chains' words as for words that were never seen.
        """
        self.langs = sorted({lang for lang, own in rows if own})
        number = {lang: k for k, lang in enumerate(self.langs)}
        texts: list[list[list[str]]] = [[] for _ in self.langs]
        for lang, own in rows:
            if own:
                texts[number[lang]].append(own)
        counts = [Counter(w for own in some[1::2] for w in own) for some in texts]
        self.lexicon: dict[str, list[str]] = {}
        for k, some in enumerate(counts):
            for w, n in some.items():
                if n >= LEAST_WORD:
                    self.lexicon.setdefault(w, []).append(f"={k}")
        for own in self.lexicon.values():
            if len(own) == 1:
                own.append("!" + own[0])
        rng = np.random.default_rng(seed)
        chains = [self._chain(texts, rng) for _ in range(CHAINS)] if len(self.langs) > 1 else []
        seen = Counter(c for chain in chains for _, w in chain for c in self.features(w))
        self.known = {c: i + 2 for i, c in enumerate(sorted(c for c, n in seen.items() if n >= LEAST_CLUE))}  # 0 padding, 1 bias
        self.crf = Crf(len(self.known) + 2, max(1, len(self.langs)))
        if chains:
            ids = [[[1, *self.ids(w)] for _, w in chain] for chain in chains]
            ids, lengths = padded(ids, max(len(f) for r in ids for f in r))
            gold = np.zeros(ids.shape[:2], dtype=int)
            for i, chain in enumerate(chains):
                gold[i, : len(chain)] = [k for k, _ in chain]
            self.crf.fit(ids, gold, lengths, rounds=ROUNDS)
        self.move, self.start = (np.exp(x - x.max()) for x in (self.crf.move, self.crf.start))
        self.weight = self.crf.weight.copy()
        del self.crf

    @staticmethod
    def _chain(texts: list[list[list[str]]], rng: np.random.Generator) -> list[tuple[int, str]]:
        """Words with their languages: stretches of texts of languages drawn alike, one after the other."""
        chain: list[tuple[int, str]] = []
        while len(chain) < CHAIN:
            k = int(rng.integers(len(texts)))
            own = texts[k][2 * int(rng.integers((len(texts[k]) + 1) // 2))]
            low, n = int(rng.integers(len(own))), int(rng.geometric(1 / RUN))
            chain += [(k, w) for w in own[low : low + n]]
        return chain[:CHAIN]

    def features(self, word: str) -> set[str]:
        """The word's clues, and the lexicons that have it: of any language, and if of one alone."""
        if _DIGIT.search(word):
            return set()
        return clues(word).union(self.lexicon.get(word, ()))

    def ids(self, word: str) -> list[int]:
        return [i for c in self.features(word) if (i := self.known.get(c))]


class Labeller:
    """Scores of words as they are met, and exact marginals of whole texts."""

    def __init__(self, model: Model):
        self.model, self.k = model, max(1, len(model.langs))
        self.seen: dict[str, int] = {}
        self.table, self.letters = np.ones((1024, self.k)), np.zeros(1024, dtype=bool)

    def learn(self, new: list[str]) -> None:
        """Adds the emission weights of words, each scaled to a largest of 1."""
        own = [[1, *self.model.ids(w)] for w in new]
        starts = np.cumsum([0, *map(len, own[:-1])])
        sums = np.add.reduceat(self.model.weight[np.fromiter((i for x in own for i in x), dtype=np.int64)], starts, axis=0)
        low, high = len(self.seen), len(self.seen) + len(new)
        while high > len(self.table):
            self.table, self.letters = np.concatenate([self.table, self.table]), np.concatenate([self.letters, self.letters])
        self.table[low:high] = np.maximum(np.exp(sums - sums.max(1, keepdims=True)), LEAST)
        self.letters[low:high] = [w.isalpha() or any(map(str.isalpha, w)) for w in new]
        self.seen.update(zip(new, range(low, high)))

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of the table."""
        if new := list(set(words).difference(self.seen)):
            self.learn(new)
        return np.fromiter(map(self.seen.__getitem__, words), dtype=np.int32, count=len(words))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all words of texts in order, and each word's text."""
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        rows, waiting, size, counts = [np.zeros(0, dtype=np.int32)], [], 0, np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            for part in _parted(text):
                own = WORD.findall(part.lower())
                waiting += own
                counts[i] += len(own)
                size += len(part)
                if size >= AT_ONCE:
                    rows.append(self.words(waiting))
                    waiting, size = [], 0
        rows.append(self.words(waiting))
        row, text = np.concatenate(rows), np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        real = self.letters[row]
        return row[real], text[real]

    def marginals(self, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Place and marginals [n, K] of pieces of the words; first marks those that begin a text.

        All words are one sequence in which a text's first word forgets what came before. It is cut into
        segments whose products of transitions carry the messages from one to the next, so the marginals
        are those of forward-backward over each whole text, however long.
        """
        k, n, move, start = self.k, len(row), self.model.move, self.model.start
        some = -(-n // SEGMENT)
        row = np.concatenate([row, np.zeros(some * SEGMENT - n, dtype=row.dtype)]).reshape(some, SEGMENT)
        first = np.concatenate([first, np.ones(some * SEGMENT - n, dtype=bool)]).reshape(some, SEGMENT)
        step = PIECE // SEGMENT
        product = np.empty((some, k, k))
        for low in range(0, some, step):
            own, new = row[low : low + step], first[low : low + step]
            p, begins = np.broadcast_to(np.eye(k), (len(own), k, k)), new.any(0)
            for t in range(SEGMENT):
                moved = (p.reshape(-1, k) @ move).reshape(-1, k, k)
                if begins[t]:
                    moved = np.where(new[:, t, None, None], p.sum(2)[:, :, None] * start, moved)
                p = moved * self.table[own[:, t]][:, None, :]
                if t % EVERY == EVERY - 1:
                    p /= p.sum((1, 2))[:, None, None]
            product[low : low + step] = p
        into, out = np.empty((some, k)), np.empty((some, k))
        a = b = np.full(k, 1 / k)
        for s in range(some):
            into[s] = a
            a = a @ product[s]
            a = a / a.sum()
        for s in range(some - 1, -1, -1):
            out[s] = b
            b = product[s] @ b
            b = b / b.sum()
        for low in range(0, some, step):
            own, new = row[low : low + step], first[low : low + step]
            e = self.table[own]
            alpha, beta = into[low : low + step], out[low : low + step]
            got, begins = np.empty_like(e), new.any(0)
            for t in range(SEGMENT):
                alpha = alpha @ move
                if begins[t]:
                    alpha[new[:, t]] = start
                alpha *= e[:, t]
                if t % EVERY == EVERY - 1:
                    alpha /= alpha.sum(1, keepdims=True)
                got[:, t] = alpha
            for t in range(SEGMENT - 1, -1, -1):
                got[:, t] *= beta
                beta = (e[:, t] * beta) @ move.T
                if begins[t]:
                    beta[new[:, t]] = 1.0
                if t % EVERY == 0:
                    beta /= beta.sum(1, keepdims=True)
            got = got.reshape(-1, k)[: n - low * SEGMENT]
            yield low * SEGMENT, got / got.sum(1, keepdims=True)

    def languages(self, texts: list[str]) -> tuple[list[str], list[float], list[int], list[int]]:
        """Each text's language, score, words, and changes of language from a word to the next."""
        row, text = self.rows(texts)
        first = np.ones(len(text), dtype=bool)
        first[1:] = text[1:] != text[:-1]
        total, best = np.zeros((len(texts), self.k)), np.empty(len(row), dtype=np.int32)
        for low, got in self.marginals(row, first):
            whose = text[low : low + len(got)]
            for k in range(self.k):
                total[:, k] += np.bincount(whose, weights=got[:, k], minlength=len(texts))
            best[low : low + len(got)] = got.argmax(1)
        n = np.bincount(text, minlength=len(texts))
        changes = np.bincount(text[1:][(best[1:] != best[:-1]) & ~first[1:]], minlength=len(texts))
        top = total.argmax(1)
        known = (n > 0) & (len(self.model.langs) > 0)
        score = np.where(known, np.clip(total[np.arange(len(texts)), top] / np.maximum(n, 1), 0, 1), 0.0)
        return [self.model.langs[t] if ok else UNKNOWN for t, ok in zip(top, known)], score.tolist(), n.tolist(), changes.tolist()

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """Stretches of words of one language: start, end (code points, end exclusive), language."""
        at = [(m.start(), m.end()) for m in WORD.finditer(text) if any(map(str.isalpha, m[0]))]
        if not at or not self.model.langs:
            return []
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        row = self.words([text[a:b].lower() for a, b in at])
        first = np.zeros(len(row), dtype=bool)
        first[0] = True
        out: list[tuple[int, int, str]] = []
        for low, got in self.marginals(row, first):
            for (a, b), k in zip(at[low:], got.argmax(1).tolist()):
                lang = self.model.langs[k]
                if out and out[-1][2] == lang:
                    out[-1] = (out[-1][0], b, lang)
                else:
                    out.append((a, b, lang))
        return out


def _parted(text: str) -> Iterator[str]:
    """The text in parts of a million characters or more, cut where no word goes on."""
    low = 0
    while low < len(text):
        found = _GAP.search(text, low + AT_ONCE) if len(text) > low + AT_ONCE else None
        high = found.start() if found else len(text)
        yield text[low:high]
        low = high


def fit(docs: DataFrame, langs: int = LANGS, rows: int = DOCS) -> Model:
    """The model from the texts and languages of documents outside the held-out fold.

    It learns the langs languages that most of them have (ties to the smaller name), each from the rows
    documents that come first by a hash of their id, of which it sees STRETCHES stretches of STRETCH words at
    places hashed from the text's length. Null languages and texts count for nothing, "" is a language. Of repeated
    rows the smallest words count. Without a language nothing is learned.
    """
    some = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = some.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    # places are even, so four times as many documents as asked for lie below this bound, and no more are ranked
    near = some.select("doc_id", "lang", place.alias("place")).join(F.broadcast(most), "lang").filter(F.col("place") <= (1 << 40) * (4.0 * rows / F.col("count")))
    first = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    chosen = F.broadcast(first.select("lang", "doc_id").distinct())  # bounded by the two parameters
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([" ".join(stretches(t)) for t in part.column(2).to_pylist()], pa.string())], names=["doc_id", "lang", "words"])

    same = some["doc_id"].eqNullSafe(chosen["doc_id"]) & (some["lang"] == chosen["lang"])
    found = map_batches(some.join(chosen, same, "leftsemi").select("doc_id", "lang", "text"), cut, f"doc_id {kind}, lang string, words string", "stretches")
    got = found.groupBy("doc_id", "lang").agg(F.min("words").alias("words")).orderBy("lang", place, "doc_id").collect()
    model = Model([(r["lang"], r["words"].split(" ") if r["words"] else []) for r in got])
    trim()
    return model


def stretches(text: str) -> list[str]:
    """Words of the fit: STRETCHES stretches of consecutive words at places that the text's length picks, all words of a short text."""
    words = [w for w in WORD.findall(text.lower()) if len(w) <= LETTERS and not _DIGIT.search(w) and any(map(str.isalpha, w))]
    if len(words) <= STRETCHES * STRETCH:
        return words
    room = len(words) // STRETCHES
    return [w for i in range(STRETCHES) for low in [i * room + (len(text) * 2654435761) % (room - STRETCH + 1)] for w in words[low : low + STRETCH]]


def predict(docs: DataFrame, model: Model, with_runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_words, switches of every whole text; with_runs adds runs, "start:end:language" in code points, comma-joined.

    Every word has the marginals of forward-backward over its whole text. A document's language is the one
    with the largest sum of them (ties to the smaller name) and score its mean; switches counts words whose
    likeliest language is not that of the word before. A null text, one without a letter, and every text if
    the model knows no language gives "und" and score 0. Repeated rows each give their row; nothing but the
    text is an input. An empty table gives an empty result; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = f"language {id(sent)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(name, lambda: Labeller(sent.value))
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                lang, score, n, changes = own.languages(texts)
                columns = [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(changes, pa.int64())]
                if with_runs:
                    columns.append(pa.array([",".join(f"{a}:{b}:{x}" for a, b, x in own.runs(t)) for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words", "switches", *["runs"] * with_runs])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double, n_words long, switches long" + ", runs string" * with_runs, name)


def op11_language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
