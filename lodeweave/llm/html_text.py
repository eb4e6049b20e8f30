"""Operator 3: main text of web pages by a recurrent labeller of their blocks."""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm.batches import map_batches, slices

BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg".split())
SECTIONS = frozenset("article aside body div footer form header main nav section table td ul ol blockquote".split())
#: A quote opens a value right after its "=" alone: elsewhere it is a letter of a name or of an unquoted value.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PATH, WORDS, NUMBERS, HIDDEN = 64, 8, 5, 24
PAGES, EPOCHS, SEED = 420, 14, 5


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """The page's leaf blocks in order: text, tag path with the classes on it, share of its text in links.

    Character references are decoded, white space is one space, blocks without text go. Tags that the page
    forgets to close end with their parent; a page may stop anywhere.
    """
    out, stack, text = [], [], []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        got = " ".join("".join(text).split())
        if got:
            out.append((got, tuple(x for _, own in stack for x in own), linked / max(1, total)))
        text.clear()
        linked = total = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        if raw:
            text.append(html.unescape(raw))
            total += len(raw)
            if any(t == "a" for t, _ in stack):
                linked += len(raw)

    at = 0
    while m := MARKUP.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (tag in BLOCK_TAGS or not any(t in BLOCK_TAGS for t, _ in stack[depth:])):
                del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID:
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or (tag in ("td", "th") and stack[i][0] in ("td", "th")):
                    del stack[i:]
                    break
                if stack[i][0] in SECTIONS:
                    break
        own = [tag]
        for a in ATTRIBUTE.finditer(m[3]):
            own += [f"{a[1].lower()}.{w.lower()}" for w in re.split(r"[\s_-]+", a[2] or a[3] or a[4] or "") if w]
        stack.append((tag, tuple(own)))
    say(page[at:])
    flush()
    return out


_TABLE = np.random.default_rng(SEED).normal(size=(4096, PATH)) / math.sqrt(PATH) * 2
_WORD = np.random.default_rng(SEED + 1).normal(size=(4096, WORDS)) / math.sqrt(WORDS)


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    return _TABLE[[zlib.crc32(x.encode()) % 4096 for x in dict.fromkeys(path)]].sum(0) if path else np.zeros(PATH)


def vectors(page: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    """One row a block: its tag path, all its words (hashed), and its length, links, end and place."""
    out = np.zeros((len(page), PATH + WORDS + NUMBERS))
    for i, (text, path, links) in enumerate(page):
        words = text.lower().split()
        out[i, :PATH] = path_vector(path)
        out[i, PATH : PATH + WORDS] = _WORD[[zlib.crc32(w.encode()) % 4096 for w in words]].mean(0)
        out[i, PATH + WORDS :] = (math.log1p(len(text)) / 4 - 1, links, text[-1] in ".!?…\"»", "©" in text, i / len(page))
    return out


class Labeller:
    """A bidirectional LSTM over a page's blocks with a logistic output, in numpy."""

    def __init__(self, seed: int = SEED):
        rng, d, h = np.random.default_rng(seed), PATH + WORDS + NUMBERS, HIDDEN
        self.p = {}
        for side in "fb":
            self.p["w" + side] = rng.normal(size=(d + h, 4 * h)) / math.sqrt(d + h)
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0
            self.p["c" + side] = bias
        self.p["v"], self.p["u"] = rng.normal(size=2 * h) / math.sqrt(h), np.zeros(1)

    def run(self, x: np.ndarray, live: np.ndarray, side: str, keep: bool):
        """Hidden states [B, T, H] of one direction; live [B, T] marks blocks."""
        b, n, _ = x.shape
        h = c = np.zeros((b, HIDDEN))
        out, tape = np.zeros((b, n, HIDDEN)), []
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            z = np.hstack([x[:, t], h])
            g = z @ self.p["w" + side] + self.p["c" + side]
            i, f, o = (1 / (1 + np.exp(-g[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            a = np.tanh(g[:, 3 * HIDDEN :])
            on = live[:, t : t + 1]
            new = f * c + i * a
            s = np.tanh(new)
            if keep:
                tape.append((t, z, i, f, o, a, c, s, on))
            c, h = np.where(on, new, c), np.where(on, o * s, h)
            out[:, t] = h
        return out, tape

    def predict(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, live, s, False)[0] for s in "fb"], axis=2)
        return 1 / (1 + np.exp(-(both @ self.p["v"] + self.p["u"])))

    def gradient(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {s: self.run(x, live, s, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        gap = (1 / (1 + np.exp(-(both @ self.p["v"] + self.p["u"]))) - y) * live / live.sum()
        out = {"v": np.einsum("bt,bth->h", gap, both), "u": np.array([gap.sum()])}
        for k, s in enumerate("fb"):
            w = self.p["w" + s]
            dw, dc = np.zeros_like(w), np.zeros_like(self.p["c" + s])
            dh = dcell = np.zeros((len(x), HIDDEN))
            for t, z, i, f, o, a, c, tc, on in reversed(runs[s][1]):
                dh = dh + gap[:, t, None] * self.p["v"][k * HIDDEN : (k + 1) * HIDDEN]
                own = dh * on
                dn = own * o * (1 - tc * tc) + dcell * on
                g = np.hstack([dn * a * i * (1 - i), dn * c * f * (1 - f), own * tc * o * (1 - o), dn * i * (1 - a * a)])
                dw += z.T @ g
                dc += g.sum(0)
                dh = (g @ w.T)[:, -HIDDEN:] + dh * ~on
                dcell = dn * f + dcell * ~on
            out["w" + s], out["c" + s] = dw, dc
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = np.argsort([len(x) + rng.random() * 6 for x, _ in pages])
            groups = [order[k : k + 24] for k in range(0, len(order), 24)]
            for k in rng.permutation(len(groups)):
                x, live, y = batch([pages[j] for j in groups[k]])
                step += 1
                for name, g in self.gradient(x, live, y).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self


def batch(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(x) for x, _ in pages)
    x, live, y = np.zeros((len(pages), n, PATH + WORDS + NUMBERS)), np.zeros((len(pages), n), dtype=bool), np.zeros((len(pages), n))
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], live[i, : len(a)], y[i, : len(a)] = a, True, b
    return x, live, y


def invented(n: int, seed: int) -> Iterator[tuple[str, str]]:
    """Pages and their main text, from a grammar of common layouts; some forget end tags or stop early."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("aeioubcdfglmnprstéüñ") for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def words(k: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(k))

    def sentence(k: int) -> str:
        out = words(k).capitalize()
        return out + rng.choice([".", ".", ".", "", " |", "!", " ***"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{words(1)}">{words(rng.randint(1, 3))}</a></li>' for _ in range(k))

    def extra() -> str:
        return rng.choice(
            [
                lambda: f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>",
                lambda: f'<div class="{rng.choice(["menu", "navbar", "breadcrumb", "nav-links"])}"><ul>{links(rng.randint(2, 6))}</ul></div>',
                lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "banner", "promo"])}">{sentence(rng.randint(2, 25))}</div>',
                lambda: f'<div class="{rng.choice(["cookie", "cookie-notice", "notice", "newsletter", "popup"])}"><p>{sentence(rng.randint(4, 20))}</p><button>{words(1)}</button></div>',
                lambda: f'<aside{rng.choice(["", " class=sidebar"])}><h3>{words(2)}</h3><p>{sentence(rng.randint(3, 30))}</p><ul>{links(rng.randint(1, 5))}</ul></aside>',
                lambda: f'<form action="/s"><label>{words(2)}</label><input name="q"><button>{words(1)}</button></form>',
                lambda: f'<header{rng.choice(["", " id=header"])}><div class="logo">{words(2)}</div><p>{sentence(rng.randint(3, 12))}</p></header>',
                lambda: f'<div class="{rng.choice(["sidebar", "related", "share", "social", "widget"])}"><h4>{words(2)}</h4><ul>{links(rng.randint(2, 6))}</ul><p>{sentence(rng.randint(3, 20))}</p></div>',
                lambda: f"<!-- {words(2)} --><script>var t='<p>{words(3)}</p>';</script>",
            ]
        )()

    for _ in range(n):
        main, body = [], ""
        title = sentence(rng.randint(3, 10))
        body += f"<h1>{title}</h1>"
        main.append(title)
        for _ in range(max(1, int(rng.expovariate(1 / 7)))):
            r, text = rng.random(), sentence(rng.choice([1, 2, 5, 12, 30, 80, 160]))
            if r < 0.12:
                tag = rng.choice(["h2", "h3", "blockquote", "li", "figcaption", "pre"])
                piece = f"<{tag}>{text}</{tag}>"
                body += f"<ul>{piece}</ul>" if tag == "li" else piece
            elif r < 0.2:
                body += f"<p><b>{text}<br>" + rng.choice(["", "</p>"])
            elif r < 0.3:
                body += f'<p>{text} <a href="/x">{words(2)}</a>' + rng.choice(["", "</p>"])
                text += " " + body[body.rindex('">') + 2 : body.rindex("</a>")]
            else:
                body += f"<p>{text}</p>"
            main.append(text)
            if rng.random() < 0.05:
                body += f'<div class="ad">{sentence(rng.randint(2, 20))}</div>'
        opening, closing = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ("<main><article>", "</article></main>")])
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>'
        page += "".join(extra() for _ in range(rng.randint(0, 4))) + opening + body + closing
        if rng.random() < 0.35:
            page += f'<{rng.choice(["section", "div"])} class="comments"><h3>{words(1)}</h3>' + "".join(f'<div class="comment"><b>{words(1)}</b><p>{sentence(rng.randint(3, 40))}</p></div>' for _ in range(rng.randint(1, 5))) + "</div>"
        page += "".join(extra() for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.85:
            page += rng.choice(["<footer>&copy; {0} &middot; {1}</footer>", '<div class="footer"><p>&copy; {0}</p><p>{1}</p></div>', "<footer><p>{1}</p></footer>"]).format(words(1), sentence(rng.randint(3, 20)))
        yield page + rng.choice(["</body></html>", "</body></html>", ""]), "\n\n".join(" ".join(t.split()) for t in main)


@lru_cache(maxsize=1)
def labeller(n: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, trained once per process on invented pages; no row of a table takes part."""
    pages = []
    for page, main in invented(n, SEED):
        own, wanted, y = blocks(page), main.split("\n\n"), []
        k = 0
        for text, path, _ in own:
            hit = k < len(wanted) and text == wanted[k] and not {"title", "aside", "nav"} & set(path)
            y.append(float(hit))
            k += hit
        pages.append((vectors(own), np.array(y)))
    return Labeller().fit(pages, epochs)


def main_text(pages: list[str], model: Labeller, group: int = 48) -> list[str]:
    """The main text of each page; pages of like length are labelled together, whole."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    k = 0
    while k < len(order):
        some = order[k : k + group]
        while len(some) > 1 and len(some) * len(parsed[some[-1]]) > 20_000:
            some = some[: len(some) // 2]
        k += len(some)
        x, live, _ = batch([(vectors(parsed[i]), np.zeros(len(parsed[i]))) for i in some])
        for i, p in zip(some, model.predict(x, live)):
            out[i] = "\n\n".join(b[0] for b, v in zip(parsed[i], p) if v >= 0.5)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty html gives the empty text. Pages are independent of each other and whole; repeated
    rows each give their row, other columns are not looked at.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    sent = pages.sparkSession.sparkContext.broadcast(labeller())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                text = main_text([h or "" for h in part.column(2).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
