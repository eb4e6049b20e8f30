"""Operator 2: secret scans by a linear-chain conditional random field beside fixed patterns."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.batches import map_batches, slices
from lodeweave.llm.crf import Crf, padded, viterbi

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the field takes as one token, what can begin a secret, and names that announce one.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
CANDIDATE = re.compile(r"[0-9]+|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
#: Characters that join the parts of one secret, in the invented lines.
JOINTS = ".&!#%*~^"
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key", "auth", "bearer", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat")
#: Code points kept on either side of what can begin a secret; everything further is outside.
AROUND, SEED, SENTENCES = 60, 11, 700
BEGIN, INSIDE, OUTSIDE = range(3)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shape(token: str) -> list[str]:
    """Features of one token alone."""
    n, digits = len(token), sum(c.isdigit() for c in token)
    lower, upper = sum(c.islower() for c in token), sum(c.isupper() for c in token)
    if not token[0].isalnum() and n == 1:
        return ["mark:" + (token if token in "\"'=:()[]{},;" else "other")]
    if digits == 0:
        kind = "lower" if lower == n else "upper" if upper == n else "title" if upper == 1 and token[0].isupper() else "mixed"
    elif digits == n:
        kind = "digits"
    elif not re.search(r"[^0-9a-f]", token):
        kind = "hex"
    elif not re.search(r"[^0-9A-Z]", token):
        kind = "upper+digits"
    else:
        kind = "letters+digits"
    size = next(str(s) for s in (3, 6, 9, 12, 16, 20, 24, 32, 40, 64, 10**9) if n <= s)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    out = ["kind:" + kind, "size:" + size, "both:" + kind + size, "turns:" + str(min(4, turns // 2))]
    low = token.lower()
    if any(x in low for x in NAMES):
        out.append("name")
    out += ["prefix:" + p for p in PREFIXES if token.startswith(p)]
    return out


def features(tokens: list[str], starts: list[int], text_kind: str) -> list[list[str]]:
    """Shape, neighbouring words and file features of each token."""
    own = [shape(t) for t in tokens]
    brief = [o[0] if len(o) == 1 or o[0][0] == "m" else "name" if "name" in o else o[0] for o in own]
    out = []
    for i, o in enumerate(own):
        near = [f"{d:+d}:{brief[i + d]}" if 0 <= i + d < len(own) else f"{d:+d}:edge" for d in (-3, -2, -1, 1)]
        joined = "joined" if i and starts[i] == starts[i - 1] + len(tokens[i - 1]) else "apart"
        out.append(["bias", text_kind, joined, joined + brief[i - 1] if i else "first", *o, *near, o[0] + near[2], o[0] + near[1]])
    return out


def text_kind(text: str) -> str:
    """The file's features: how much of it is marks of code."""
    marks = sum(text.count(c) for c in "={};<>")
    return "file:code" if marks * 40 > len(text) else "file:some" if marks * 400 > len(text) else "file:prose"


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Invented lines with the spans of the secrets in them: assignments, keys, digests, and numbers that are no secret."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum, low = string.ascii_letters + string.digits, string.digits + "abcdef"
    word = lambda: rng.choice([pick("etaoinshrdlu", rng.randint(1, 9)), pick("etaoinshrdlu", rng.randint(1, 8)).title(), pick("enrstié", rng.randint(12, 26)), pick("ETAOIN", rng.randint(2, 6))])
    values = [lambda: pick(low, rng.choice([18, 20, 24, 32, 40, 64])), lambda: pick(alnum, rng.randint(12, 40)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(alnum, rng.randint(20, 36)), lambda: "eyJ" + pick(alnum + "-_", rng.randint(24, 60)), lambda: pick(alnum + "+/", 40)]
    values += [lambda: ".".join(["eyJ" + pick(alnum + "-_", rng.randint(16, 30)), pick(alnum + "-_", rng.randint(20, 60)), pick(alnum + "-_", rng.randint(20, 43))]), lambda: "SG." + pick(alnum, 22) + "." + pick(alnum, 43)]
    # with a name before them only: as words with numbers and marks they could be anything
    named = [lambda: rng.choice(JOINTS).join(pick(alnum, rng.randint(3, 9)) + str(rng.randint(0, 99)) for _ in range(rng.randint(2, 3)))]
    plain = [lambda: pick(string.digits, rng.randint(1, 7)), lambda: pick(string.digits, 16), lambda: f"+{rng.randint(1, 99)} ({pick(string.digits, 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{word().lower()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: "https://" + pick("abcdefgh", 8) + "/" + pick(string.digits, 4) + ".html", lambda: word() + rng.choice(["***", "$$$", "%%%", "###"]), lambda: "| " + word() + " |", lambda: "#" + pick(low, 6), lambda: word() + "=" + str(rng.randint(0, 999)), lambda: word() + "=" + word().lower(), lambda: pick("=-*", rng.randint(3, 30)), lambda: "the token " + word() + " and the secret " + word() + ": " + word()]
    for _ in range(n):
        out, spans, code = "", [], rng.random() < 0.25
        for _ in range(rng.randint(4, 12)):
            r = rng.random()
            if r < 0.12:
                value = rng.choice(values)()
                if rng.random() < 0.6:
                    value = rng.choice(named)() if rng.random() < 0.3 else value
                    name = rng.choice(NAMES)
                    name = rng.choice([name, name.upper(), "db_" + name, '"' + name + '"'])
                    quote = rng.choice(['"', "'", "", ""])
                    out += name + rng.choice(["=", " = ", ": ", ":"]) + quote
                else:
                    quote = ""
                spans.append((len(out), len(out) + len(value)))
                out += value + quote
            elif r < 0.4:
                out += rng.choice(plain)()
            else:
                out += word() + (rng.choice([" = ", "(", ");", " {"]) if code else rng.choice(["", "", "", ",", "."]))
            out += rng.choice([" ", " ", " ", "\n"])
        yield out, spans


class Tagger:
    """The field, trained once per process on invented lines; no document takes part."""

    def __init__(self, n: int = SENTENCES, seed: int = SEED):
        self.ids: dict[str, int] = {}
        rows, truth = [], []
        for text, spans in sentences(n, seed):
            tokens, starts = self.tokens(text)
            if not tokens:
                continue
            rows.append([[self.ids.setdefault(f, len(self.ids) + 1) for f in own] for own in features(tokens, starts, text_kind(text))])
            tag = []
            for s, t in zip(starts, tokens):
                inside = next((a for a, b in spans if a <= s < b), None)
                tag.append(OUTSIDE if inside is None else BEGIN if inside == s else INSIDE)
            truth.append(tag)
        width = max(len(o) for r in rows for o in r)
        ids, lengths = padded(rows, width)
        gold = np.full(ids.shape[:2], OUTSIDE)
        for i, tag in enumerate(truth):
            gold[i, : len(tag)] = tag
        self.crf = Crf(len(self.ids) + 1, 3).fit(ids, gold, lengths, rounds=45)
        self.crf.move[OUTSIDE, INSIDE] = self.crf.start[INSIDE] = -1e6  # a secret begins with its beginning

    @staticmethod
    def tokens(text: str) -> tuple[list[str], list[int]]:
        got = [(m[0], m.start()) for m in TOKEN.finditer(text)]
        return [t for t, _ in got], [s for _, s in got]

    def decode(self, text: str, kind: str, offset: int = 0) -> list[tuple[int, int]]:
        """Spans that the best tag sequence of text gives."""
        tokens, starts = self.tokens(text)
        if not tokens:
            return []
        get, weight = self.ids.get, self.crf.weight
        emit = np.array([weight[[get(f, 0) for f in own]].sum(0) for own in features(tokens, starts, kind)])
        spans: list[list[int]] = []
        for tag, token, start in zip(viterbi(emit, self.crf.move, self.crf.start), tokens, starts):
            if tag == BEGIN:
                spans.append([offset + start, offset + start + len(token)])
            elif tag == INSIDE and spans:
                spans[-1][1] = offset + start + len(token)
        return [(a, b) for a, b in spans]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets of a whole text: decoded around everything that can begin one, the rest being outside."""
        marks = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
        low = text.lower()
        if len(low) != len(text):  # places differ: a letter became several
            low = text.translate(_LOWER)
        for name in NAMES:
            at = low.find(name)
            while at >= 0:
                marks.append((at, at + len(name)))
                at = low.find(name, at + 1)
        if not marks:
            return []
        kind, out, n = text_kind(text), [], len(text)
        marks.sort()
        runs: list[list[int]] = []
        for a, b in marks:
            a, b = max(0, a - AROUND), min(n, b + AROUND)
            if runs and a <= runs[-1][1] + AROUND:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for a, b in runs:
            while 0 < a and not text[a - 1].isspace():
                a -= 1
            while b < n and not text[b].isspace():
                b += 1
            out += self.decode(text[a:b], kind, a)
        return sorted(set(out))


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def find(text: str, tag: Tagger) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and all: theirs and those of the field's that no pattern covers whole.

    A span of the field may begin in one of a pattern's and reach beyond it: a secret that the pattern cuts short.
    """
    base, more = base_spans(text), []
    for a, b in tag.spans(text):
        bare = a
        for x, y, _ in base:
            if x <= bare < y:
                bare = y
        if b - a >= 6 and bare < b:
            more.append((a, b, "crf"))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, redact: str | None = None) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans; with redact also text, secrets replaced by it.

    Null texts count as empty (and stay null when redacted); repeated rows each give their row. The model
    is trained on the driver from invented lines and goes to the executors once; rows are independent.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", text string" * (redact is not None)
    names = [f.split()[0] for f in fields.split(", ")]
    tag = docs.sparkSession.sparkContext.broadcast(tagger())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tag.value
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text in part.column(1).to_pylist():
                    base, every = find(text or "", own)
                    row = [*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)]
                    rows.append(row if redact is None else [*row, hidden(text, every, redact)])
                types = [pa.int64()] * 3 + [pa.string()] * (len(names) - 4)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return map_batches(docs.select("doc_id", "text"), work, fields)


def hidden(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    """text with what any span covers replaced by mark."""
    if text is None or not spans:
        return text
    out, at, open_end = [], 0, -1
    for a, b, _ in spans:
        if a >= open_end:
            out += [text[at:a], mark]
        open_end = at = max(open_end, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars, where there is one, as the text now has.

    What any span covers is replaced once. Null texts stay null (and so does their n_chars), empty ones
    empty; repeated rows, null ids and other columns stay as they are; an empty table stays empty.
    """
    names, tag = docs.columns, docs.sparkSession.sparkContext.broadcast(tagger())
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tag.value
        for batch in batches:
            for part in slices(batch, names.index("text")):
                texts = [hidden(t, find(t, own)[1], mark) if t else t for t in part.column(names.index("text")).to_pylist()]
                new = {"text": pa.array(texts, part.column(names.index("text")).type)}
                if "n_chars" in names:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.column(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(names, part.columns)], names=names)

    return map_batches(docs, work, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
