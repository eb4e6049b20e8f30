"""A store that follows a folder, windows that overlap, and running counts, against plain versions."""

import random

from pyspark.sql import functions as F

from lodeweave.operators import graph
from lodeweave.operators.prefix import running
from lodeweave.operators.store import Store
from lodeweave.streaming import listing, watch


def test_store_follows_edits_renames_and_deletions(spark, tmp_path):
    folder, store = tmp_path / "notes", Store(spark, str(tmp_path / "index"))
    (folder / "sub").mkdir(parents=True)
    (folder / ".git").mkdir()
    for name, text in (("a.md", "# One\nThe first note is here."), ("sub/b.md", "# Two\nA second note is here."), ("c.md", "# Three\nA third note is here."), ("skip.txt", "no note"), (".git/d.md", "no note of ours")):
        (folder / name).write_text(text)

    def cycle():
        stream = listing.changes(spark, str(folder), str(tmp_path / "manifests"))
        watch.mirror(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
        return {r["doc_path"]: r["text"] for r in store.table("documents").collect()}

    assert set(cycle()) == {"a.md", "sub/b.md", "c.md"}
    first = store.last_batch()
    assert cycle() and store.last_batch() == first  # nothing has changed
    (folder / "a.md").write_text("# One\nThe first note is another now.")
    (folder / "sub" / "b.md").rename(folder / "sub" / "moved.md")
    (folder / "c.md").unlink()
    (folder / "e.md").write_bytes(b"# Five\nBytes \xff that are no text.")
    got = cycle()
    assert set(got) == {"a.md", "sub/moved.md", "e.md"} and "another" in got["a.md"] and "�" in got["e.md"]
    assert store.last_batch() == first + 1  # one commit for all of it
    for f in folder.rglob("*.md"):
        f.unlink()
    assert cycle() == {} and store.table("postings").count() == 0


def test_a_batch_that_runs_again_is_the_same(tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.md").write_text("x")
    reader = listing.Changes(str(folder), str(tmp_path / "m"), "*.md")
    one = reader.latestOffset()
    assert one == reader.latestOffset() == {"listing": 1}
    (folder / "b.md").write_text("y")
    (folder / "a.md").unlink()
    two = listing.Changes(str(folder), str(tmp_path / "m"), "*.md").latestOffset()
    parts = [c for p in reader.partitions(one, two) for c in p.changes]
    assert parts == [("b.md", "upsert"), ("a.md", "gone")] == [c for p in reader.partitions(one, two) for c in p.changes]
    (folder / "b.md").unlink()
    rows = [r[:3] for p in reader.partitions(one, two) for r in reader.read(p)]
    assert rows == [("a.md", "gone", None)]  # what has vanished since is left to the next listing
    reader.commit(two)
    assert [f.name for f in (tmp_path / "m").iterdir()] == ["2.json"]


def test_sync_is_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(r, "doc_path string, text string, checksum string")
    store.add(rows(("a", "text of one note", "1"), ("b", "text of another", "2")))
    before = store.last_batch()
    assert store.sync(rows(("b", "text of another", "2"), ("c", "a third text here", "3"))) == (1, 1)
    assert store.last_batch() == before + 1 and {r["doc_path"] for r in store.table("documents").collect()} == {"b", "c"}


FACTS = "id string, subject string, predicate string, object string, valid_from string, valid_to string"


def plain(rows):
    low, high = (lambda r: r[4] or "0000-01-01"), (lambda r: r[5] or "9999-12-31")
    out = set()
    for a in rows:
        for b in rows:
            if None not in (*a[:4], *b[:4]) and a[1:3] == b[1:3] and a[0] < b[0] and a[3] != b[3] and low(a) <= high(b) and low(b) <= high(a):
                out.add((a[1], a[2], a[0], b[0], a[3], b[3]))
    return out


def test_contradictions_equal_all_pairs(spark):
    rng = random.Random(3)
    day = lambda: rng.choice([None, *(f"2020-01-{d:02}" for d in range(1, 13))])
    rows = [(f"f{i:03}", rng.choice(["s", "t", None]), rng.choice("pq"), rng.choice(["x", "y", "z", None]), day(), day()) for i in range(260)]
    rows += [("f000", "s", "p", "y", None, None), (None, "s", "p", "y", None, None), rows[5]]
    got = {tuple(r) for r in graph.contradictions(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == plain(rows)
    assert graph.contradictions(spark.createDataFrame([], FACTS)).count() == 0


def test_a_busy_subject_makes_few_pairs(spark):
    day = lambda c: F.date_format(F.date_add(F.lit("1900-01-01"), c.cast("int")), "yyyy-MM-dd")
    i = F.col("id")
    facts = spark.range(40_000).select(i.cast("string").alias("id"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"), i.cast("string").alias("object"), day(i).alias("valid_from"), day(i + F.when(i % 1000 == 0, 2).otherwise(0)).alias("valid_to"))
    assert graph.contradictions(facts).count() == sum(min(2, 39_999 - i) for i in range(0, 40_000, 1000))


def test_running_counts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i, rng.random() < 0.4) for i in range(3000)]
    got = running(spark.createDataFrame(rows, "a long, b long, c boolean"), ["a", "b"], F.col("c"), "n").collect()
    n, want = 0, {}
    for a, b, c in sorted(rows):
        n += c
        want[b] = n
    assert {r["b"]: r["n"] for r in got} == want
