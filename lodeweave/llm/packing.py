"""Operator 10: packing documents into sequences by the configuration linear program."""

from __future__ import annotations

import gc
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import config_lp
from lodeweave.llm.batches import kept, map_batches, slices
from lodeweave.llm.ranking import ranked
from lodeweave.session import stored

CAPACITY, END = 4096, 1
#: Words of one generation that a worker remembers the ids of; the generation before stays, what is met again moves on.
REMEMBERED = 150_000
TOKENIZER = "word_bpe_49k.json"
#: Words that are encoded together, one a line: letters of Latin-1, which lower-casing and NFC treat one by one, then ASCII marks but the apostrophe.
_LATIN, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
_LETTERS, _MARKED = re.compile(f"^{_LATIN}$", re.M), re.compile(f"^({_LATIN})({_MARKS})$", re.M)
_OTHER = re.compile(f"^(?!{_LATIN}(?:{_MARKS})?$).+$", re.M)
_GAP = re.compile("[ \n\t\r]")
#: Characters of text that are worked on at once, at least.
AT_ONCE = 1 << 20


class Generations:
    """What words give, for as long as they are asked for: a word that a whole generation did not meet is forgotten."""

    def __init__(self):
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> set[str]:
        """The words that are not known; all others are in new after."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {"": b""}
        lost = words.difference(self.new)
        again = lost.intersection(self.old)
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return lost - again


class WordCoder:
    """Token ids of texts, as the tokenizer gives them, with every word's ids computed once per worker.

    The vocabulary's tokens never cross white space, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # letters in lower case need no more than their bytes
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.raw = Generations(), {"": b""}

    def direct(self, some: set[str]) -> None:
        words = list(some)
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.words.new[word] = np.array(got.ids, dtype="<u4").tobytes()

    def letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of runs of lower-case letters: each gives one token that ends a word, its last."""
        for k in range(0, len(words), 250):
            some = words[k : k + 250]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from [raw[i:j] for i, j in zip([0, *stops], stops)]

    def learn(self, new: set[str]) -> None:
        """Puts the ids of words, cores in lower case among them, into self.words."""
        bare = _LETTERS.findall("\n".join(new))
        self.words.new.update(zip(bare, self.letters(bare), strict=True))
        self.direct(new.difference(bare))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; parts of AT_ONCE characters or more are worked on together."""
        waiting, size = [], 0
        for text in texts:
            if len(text) > AT_ONCE:
                yield from self._ids(waiting)
                waiting, size = [], 0
                yield b"".join(x for part in _parted(text) for x in self._ids([part]))
                continue
            waiting.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self._ids(waiting)
                waiting, size = [], 0
        yield from self._ids(waiting)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.raw) > REMEMBERED:
            self.raw = {"": b""}
        if fresh := set().union(*split).difference(self.raw):
            self.read(fresh)
        get = self.raw.__getitem__
        return (b"".join(map(get, words)) for words in split)

    def read(self, fresh: set[str]) -> None:
        """Puts the ids of words as texts write them into self.raw."""
        lines = "\n".join(fresh)
        bare, marked, other = _LETTERS.findall(lines), _MARKED.findall(lines), _OTHER.findall(lines)
        # words that differ in case or in marks at their end share one core
        cores = "\n".join([*bare, *(c for c, _ in marked)]).lower().split("\n") if bare or marked else []
        marks = {m for _, m in marked}
        if new := self.words.missing({*cores, *marks, *other}):
            self.learn(new)
        known = self.words.new
        get = known.__getitem__
        self.raw.update(zip(other, map(get, other)))
        self.raw.update(zip(bare, map(get, cores)))
        self.raw.update((c + m, known[low] + known[m]) for (c, m), low in zip(marked, cores[len(bare) :], strict=True))


def _parted(text: str) -> Iterator[str]:
    """Parts of a text of at least AT_ONCE characters, cut at white space."""
    low = 0
    while low < len(text):
        found = _GAP.search(text, low + AT_ONCE)
        high = found.start() if found else len(text)
        yield text[low:high]
        low = high


def _tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then end, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32.

    tokenizer is a file's path, or the name of one of the public tokenizers. A null text counts as empty
    and gives the one id end. with_ids adds the ids. Repeated rows each give their own pieces.
    """
    kind = docs.schema["doc_id"].dataType
    fields = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _tokenizer_path(tokenizer)
        code = kept(f"coder {path}", lambda: WordCoder(path))
        gc.disable()  # nothing here refers back to itself, and a collection looks at every remembered word
        try:
            yield from parts(code, batches)
        finally:
            gc.enable()

    def parts(code: WordCoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE):
                rows, piece, start, length, crc, held = [], [], [], [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for row, ids in enumerate(code.encode(texts)):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            held.append(np.frombuffer(own, dtype="<u4").astype(np.int64))
                columns = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs.select("doc_id", "text"), cut, fields, f"coder {_tokenizer_path(tokenizer)}")


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """Runs of places, sorted by length and first rank: length, first rank (from 0), places, pieces per sequence, first sequence, offset."""
    run, first = [], 0
    for n, items in plan:
        offset = 0
        for length in sorted(items, reverse=True):
            run.append((length, n * items[length], items[length], first, offset))
            offset += length * items[length]
        first += n
    out, start = [], Counter()
    for length, size, *rest in sorted(run):
        out.append((int(length), start[length], int(size), *map(int, rest)))
        start[length] += int(size)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (rows of pieces()) with sequence_id and offset: its places, gapless from 0, in few sequences.

    The histogram of lengths, at most capacity rows, goes to the driver; config_lp solves and rounds the
    configuration program over it. Each length's pieces are ranked by doc_id and piece across all
    partitions, and a piece finds its place by its rank among the runs of its length in the plan,
    whose number depends on the histogram alone. An empty table gives an empty result.
    """
    cut = stored(cut, "pieces")
    rows = cut.groupBy("length").count().collect()
    table = slots(config_lp.plan([r[0] for r in rows], [r[1] for r in rows], capacity))
    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    placed = ranked(cut, ["length"], order)
    runs = cut.sparkSession.createDataFrame(table, "_length long, _start long, _size long, _per long, _first long, _offset long")
    k = F.col("rank") - 1 - F.col("_start")
    # the runs are bounded by the histogram: a few for each length
    found = placed.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("rank") > F.col("_start")) & (F.col("rank") <= F.col("_start") + F.col("_size")))
    return found.select(*cut.columns, (F.col("_first") + F.floor(k / F.col("_per"))).alias("sequence_id"), (F.col("_offset") + k % F.col("_per") * F.col("length")).alias("offset"))


def op10_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
