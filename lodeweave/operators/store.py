"""A kept index: documents, passages, postings and facts on shared storage, changed by batches.

Every change appends. A batch first adds its rows to the tables and to the catalogue, then one row to the commits,
which makes it valid: for readers rows of a run that is not committed do not exist. A job that dies so leaves
the index as it was, and as unchanged checksums are passed over it may run again.
The state of a document is the row of its latest batch. compact() writes what is valid anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodeweave.functions import text as T
from lodeweave.operators import chunks as C
from lodeweave.operators import facts as X
from lodeweave.operators import kept
from lodeweave.session import dropped, stored
from lodeweave.sources import vault

CATALOGUE = "doc_path string, checksum string, removed boolean, batch long, run string"
COMMITS = "batch long, run string"
SETTINGS = "analyzer string, place long"
TABLES = {
    "documents": "doc_path string, text string, meta map<string,string>, body string, batch long, run string",
    "chunks": "doc_path string, ordinal int, section_id string, heading string, start int, content string, chunk_id string, n_tokens int, batch long, run string",
    "postings": "term string, doc_path string, chunk_id string, tf long, dl int, batch long, run string",
    "facts": "subject string, predicate string, object string, source string, place int, extracted boolean, doc_path string, batch long, run string",
}


class Store:
    """An index below a folder that all executors reach. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str, size: int = 400, overlap: int = 50, heading_context: bool = False):
        C.checked(size, overlap)
        self.spark, self.root = spark, root.rstrip("/")
        self.shape = {"size": size, "overlap": overlap, "heading_context": heading_context}

    def _read(self, name: str, kind: str) -> DataFrame:
        try:
            return self.spark.read.schema(kind).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kind)

    def catalogue(self) -> DataFrame:
        """(doc_path, checksum, removed, batch, run): the latest entry of each document, removed ones too."""
        every = self._read("catalogue", CATALOGUE).join(self._read("commits", COMMITS).select("run"), "run", "left_semi")
        best = every.groupBy("doc_path").agg(F.max(F.struct("batch", "run", "checksum", "removed")).alias("e"))
        return best.select("doc_path", "e.checksum", "e.removed", "e.batch", "e.run")

    def table(self, name: str) -> DataFrame:
        """The valid rows of documents, chunks, postings or facts."""
        valid = self.catalogue().filter("not removed").select("doc_path", "batch", "run")
        rows = self._read(name, TABLES[name])
        read = rows.filter("extracted") if name == "facts" else rows
        kept = read.join(valid, ["doc_path", "batch", "run"], "left_semi")
        if name == "facts":
            kept = kept.unionByName(rows.filter("not extracted"))
        return kept.select(*(c for c in rows.columns if c not in ("batch", "run")))

    def analyzer(self) -> str:
        """The analyzer that searches go by: the one last chosen, porter+english if none was."""
        last = self._read("settings", SETTINGS).agg(F.max_by("analyzer", "place")).first()[0]
        return last or kept.DEFAULT

    def reindex(self, analyzer: str) -> kept.Index:
        """Chooses another analyzer and builds its index from the kept passages; no source is read again."""
        kept.checked(analyzer)
        place = self._read("settings", SETTINGS).count()
        self.spark.createDataFrame([(analyzer, place)], SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.root}/settings")
        return self.index()

    def index(self) -> kept.Index:
        """The index of the valid passages as of the last commit: built when it is first asked for, then read."""
        analyzer = self.analyzer()
        last = self._read("commits", COMMITS).agg(F.max(F.struct("batch", "run"))).first()[0]
        root = f"{self.root}/index/{analyzer}/{f'{last[0]}-{last[1]}' if last else 'none'}"
        return kept.Index.opened(self.spark, root) or kept.Index.build(self.table("chunks"), root, ["doc_path", "ordinal", "start"], analyzer=analyzer)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(item_id, rank, score, chunk_id, doc_path, content): the k best passages of each query (item_id, text)."""
        index = self.index()
        found = index.search(kept.query_terms(queries, index.analyzer), k)
        return index.named(found, ["chunk_id", "doc_path", "content"]).select("item_id", "rank", "score", "chunk_id", "doc_path", "content")

    def chunks_of(self, paths: DataFrame) -> DataFrame:
        """The passages of documents (doc_path) in order: (doc_path, place, ...), place from 1."""
        own = self.table("chunks").join(paths.select("doc_path").distinct(), "doc_path", "left_semi")
        return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_path").orderBy("ordinal", "start")))

    def last_batch(self) -> int:
        return self._read("commits", COMMITS).agg(F.max("batch")).first()[0] or 0

    def add(self, docs: DataFrame, force: bool = False, gone: DataFrame | None = None) -> int:
        """Takes up documents (doc_path, text, checksum) that are new or changed; how many they were.

        Documents of gone (doc_path) that are not among docs are removed in the same commit, so that no reader sees one without the other.

        Of rows with one path the one of the greatest checksum counts; a null path is left out. A text without a passage is
        kept without one.
        """
        one = docs.filter("doc_path is not null").select("doc_path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("checksum", F.lit("")).alias("checksum"))
        one = one.withColumn("_i", F.row_number().over(Window.partitionBy("doc_path").orderBy(F.desc("checksum"), "text"))).filter("_i = 1").drop("_i")
        if not force:
            same = self.catalogue().filter("not removed").select("doc_path", "checksum")
            one = one.join(same, ["doc_path", "checksum"], "left_anti")
        batch, run = self.last_batch() + 1, uuid.uuid4().hex
        fresh = stored(vault.parsed(one), "changed")
        n = fresh.count()
        mark = lambda df: df.withColumns({"batch": F.lit(batch).cast("long"), "run": F.lit(run)})
        entries = mark(fresh.withColumn("removed", F.lit(False))).select("doc_path", "checksum", "removed", "batch", "run")
        lost = None
        if gone is not None:
            out = gone.select("doc_path").distinct().join(docs.select("doc_path"), "doc_path", "left_anti")
            lost = stored(self.catalogue().filter("not removed").join(out, "doc_path", "left_semi").select("doc_path", "checksum"), "gone")
            lost = None if lost.isEmpty() else lost
        if lost is not None:
            entries = entries.unionByName(mark(lost.withColumn("removed", F.lit(True))))
        if n:
            tokens = C.of_documents(fresh, **self.shape).withColumn("t", T.tokens(F.col("content")))
            self._append("documents", mark(fresh))
            self._append("chunks", mark(tokens.withColumn("n_tokens", F.size("t"))))
            terms = tokens.select("doc_path", "chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "doc_path", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
            self._append("postings", mark(terms))
            self._append("facts", mark(X.extracted(fresh).withColumn("doc_path", F.col("source"))))
        if n or lost is not None:
            self._enter(entries, batch, run)
        dropped(fresh)
        return n

    def forget(self, paths: DataFrame) -> int:
        """Removes documents (doc_path) with all that was read from them; asserted facts stay. How many there were."""
        batch, run = self.last_batch() + 1, uuid.uuid4().hex
        gone = self.catalogue().filter("not removed").join(paths.select("doc_path").distinct(), "doc_path", "left_semi")
        gone = stored(gone.select("doc_path", "checksum", F.lit(True).alias("removed"), F.lit(batch).cast("long").alias("batch"), F.lit(run).alias("run")), "gone")
        n = gone.count()
        if n:
            self._enter(gone, batch, run)
        dropped(gone)
        return n

    def sync(self, docs: DataFrame) -> tuple[int, int]:
        """Makes the index hold exactly docs, in one commit: (documents taken up, documents removed)."""
        vanished = self.catalogue().filter("not removed").join(docs.select("doc_path"), "doc_path", "left_anti")
        vanished = stored(vanished.select("doc_path"), "vanished")
        return self.add(docs, gone=vanished), vanished.count()

    def difference(self, docs: DataFrame) -> DataFrame:
        """(doc_path, state): new, changed, deleted or unchanged, of docs (doc_path, checksum) against the index."""
        had = self.catalogue().filter("not removed").select("doc_path", F.col("checksum").alias("_had"))
        has = docs.select("doc_path", F.coalesce("checksum", F.lit("")).alias("_has"))
        state = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "deleted").when(F.col("_had") == F.col("_has"), "unchanged").otherwise("changed")
        return had.join(has, "doc_path", "full").select("doc_path", state.alias("state"))

    def assert_facts(self, facts: DataFrame) -> None:
        """Adds facts (subject, predicate, object, source) that no document's change takes away."""
        rows = facts.select(*(F.trim(c).alias(c) for c in ("subject", "predicate", "object")), "source", F.lit(0).alias("place"), F.lit(False).alias("extracted"), F.col("source").alias("doc_path"), F.lit(0).cast("long").alias("batch"), F.lit("").alias("run"))
        self._append("facts", rows)

    def compact(self, root: str) -> Store:
        """The valid rows alone, as an index below another folder."""
        other = Store(self.spark, root, **self.shape)
        valid = self.catalogue().filter("not removed")
        for name in TABLES:
            rows = self.table(name).withColumns({"batch": F.lit(1), "run": F.lit("compact")})
            other._append(name, rows)
        other._enter(valid.withColumns({"batch": F.lit(1).cast("long"), "run": F.lit("compact")}), 1, "compact")
        return other

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        kinds = dict(zip(columns, (c.split()[1] for c in TABLES[name].split(", "))))
        rows.select(*(F.col(c).cast(kinds[c]) for c in columns)).write.mode("append").parquet(f"{self.root}/{name}")

    def _enter(self, rows: DataFrame, batch: int, run: str) -> None:
        rows.select("doc_path", "checksum", "removed", "batch", "run").write.mode("append").parquet(f"{self.root}/catalogue")
        self.spark.createDataFrame([(batch, run)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
