"""Injected encoders and scorers against plain counts."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest

from lodeweave.operators import kept, rerank


class Hashing:
    """Words counted by their hashes; notes the worker that made it."""

    def __init__(self, log=None):
        if log:
            with open(log, "a") as f:
                f.write(f"{os.getpid()}\n")

    def encode(self, texts):
        out = np.zeros((len(texts), 32))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                row[int(hashlib.md5(w.encode()).hexdigest(), 16) % 32] += 1
        return out

    def score(self, queries, texts):
        return [len(set(q.split()) & set(t.split())) for q, t in zip(queries, texts)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        words = [f"w{(i * j) % 37}" for j in range(1, 330)]
        rows += [(f"d{i}", k, f"s{i}-{k}", 0, " ".join(words[k * 110 : (k + 1) * 110]), f"c{i}-{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_path string, ordinal int, section_id string, start int, content string, chunk_id string")
    return kept.Index.build(docs, str(tmp_path_factory.mktemp("i") / "x"), ["doc_path", "ordinal"], analyzer="plain")


def test_dense_order_is_fused_with_the_pools(spark, index, tmp_path):
    queries = spark.createDataFrame([(1, "w3 w5 w9 w12"), (2, "w1 w30")], "item_id long, text string")
    pool = index.search(kept.query_terms(queries, "plain"), 30)
    log = str(tmp_path / "log")
    got = rerank.dense(index, pool, queries, lambda: Hashing(log), 6, name=f"hash {tmp_path}").collect()
    texts, model = defaultdict(list), Hashing()
    for r in index.passages().orderBy("pid").collect():
        texts[r["doc_path"]].append(r["content"])
    place = defaultdict(list)
    for r in pool.join(index.passages().select("pid", "doc_path"), "pid").orderBy("item_id", "rank").collect():
        if r["doc_path"] not in place[r["item_id"]]:
            place[r["item_id"]].append(r["doc_path"])
    for q in queries.collect():
        vec, cosine = rerank.normalised(model.encode([q["text"]]))[0], {}
        for d in place[q["item_id"]]:
            words = " ".join(texts[d]).split()
            windows = [" ".join(words[i : i + 200]) for i in range(0, max(1, len(words) - 50), 150)]
            cosine[d] = round(float((rerank.normalised(model.encode(windows)) @ vec).max()), 9)
        docs = place[q["item_id"]]
        dense = sorted(docs, key=lambda d: (-cosine[d], docs.index(d)))
        want = sorted(docs, key=lambda d: (-round(1 / (61 + docs.index(d)) + 1 / (61 + dense.index(d)), 9), docs.index(d)))[:6]
        own = sorted((r for r in got if r["item_id"] == q["item_id"]), key=lambda r: r["rank"])
        assert [r["doc_path"] for r in own] == want and all(abs(r["cosine"] - cosine[r["doc_path"]]) < 1e-8 for r in own)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))  # one model a worker


def test_pairs_change_the_head_alone(spark, index):
    queries = spark.createDataFrame([(1, "w3 w5 w9 w12")], "item_id long, text string")
    pool = index.search(kept.query_terms(queries, "plain"), 30)
    before = [(r["pid"], r["content"]) for r in pool.join(index.passages().select("pid", "content"), "pid").orderBy("rank").collect()]
    score = {p: len({"w3", "w5", "w9", "w12"} & set(c.split())) for p, c in before}
    head = sorted([p for p, _ in before[:10]], key=lambda p: -score[p])
    got = [r["pid"] for r in rerank.pairs(index, pool, queries, Hashing, 15, name="pairs", depth=10).orderBy("rank").collect()]
    assert got == head + [p for p, _ in before[10:15]]
    with pytest.raises(ValueError):
        rerank.pairs(index, pool, queries, Hashing, 5, depth=0)
    with pytest.raises(ValueError):
        rerank.dense(index, pool, queries, Hashing, 5, window=10, step=20)


def test_vectors_of_length_one():
    rows = rerank.normalised([[3, 4], [0, 0]])
    assert rows.tolist() == [[0.6, 0.8], [0.0, 0.0]]
