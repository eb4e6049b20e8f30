"""Folders of Markdown files, benchmark folders and question lists as tables; graphs as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodeweave.functions import markdown as M

#: Folders of tools, which hold no documents, as do all whose names begin with a dot.
TOOLS = ("__pycache__", "node_modules")
FILE = "path string, modificationTime timestamp, length long, content binary"


def _documents(files: DataFrame, root: str) -> DataFrame:
    """(doc_path, text, checksum, modified) of binary files; bytes that are no UTF-8 become U+FFFD."""
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    if "://" in root:  # the store's own name is no part of a document's path
        base = "/" + root.split("://", 1)[1].strip("/") + "/"
    path = F.when(F.startswith(bare, F.lit(base)), F.substr(bare, F.lit(len(base) + 1))).otherwise(bare)
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    kept = ~F.exists(folders, lambda p: p.isin(*TOOLS) | F.startswith(p, F.lit(".")))
    return files.select(path.alias("doc_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("checksum"), F.col("modificationTime").alias("modified")).filter(kept)


def documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Files below root whose names match pattern, tools' folders left out; an empty folder gives no rows.

    Files without a byte are not seen, as Spark's file sources pass over them: a document that was emptied counts as gone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return _documents(files, root)


def arriving(spark: SparkSession, root: str, pattern: str = "*.md", files_a_batch: int = 10_000) -> DataFrame:
    """The same as a stream of new files; a file that is written again under its name is not seen again by Spark's file source."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(root)
    return _documents(files, root)


def parsed(docs: DataFrame) -> DataFrame:
    """Documents with their front matter (meta) and the text after it (body)."""
    return docs.withColumn("_front", M.front_matter(F.col("text"))).select("*", "_front.meta", "_front.body").drop("_front")


def benchmark(spark: SparkSession, root: str, split: str = "test", max_queries: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus (doc_id, text), queries (query_id, text), qrels (query_id, doc_id, grade)) of corpus.jsonl, queries.jsonl and qrels/<split>.tsv.

    Judgements of no gain or of unknown documents are out, and so are queries without a judgement; max_queries takes the first by id.
    """
    text = lambda *names: S.StructType([S.StructField(n, S.StringType()) for n in names])
    read = lambda name, schema: spark.read.schema(schema).json(f"{root}/{name}.jsonl")
    corpus = read("corpus", text("_id", "title", "text"))
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    corpus = corpus.filter("_id is not null").select(F.col("_id").alias("doc_id"), M.stripped(body).alias("text"))
    lines = spark.read.schema(text("query_id", "doc_id", "grade")).csv(f"{root}/qrels/{split}.tsv", sep="\t", quote="")
    qrels = lines.select("query_id", "doc_id", F.col("grade").try_cast("int").alias("grade")).filter("grade > 0")
    qrels = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "grade")
    queries = read("queries", text("_id", "text")).select(F.col("_id").alias("query_id"), "text")
    queries = queries.join(qrels.select("query_id"), "query_id", "left_semi")
    if max_queries is not None:
        queries = queries.orderBy("query_id").limit(max_queries)
        qrels = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    return corpus, queries, qrels


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_type, expected array): question lists with expected_docs or expected_doc."""
    kind = "query string, query_type string, expected_doc string, expected_docs array<string>"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    one = F.when(F.col("expected_doc").isNotNull(), F.array("expected_doc"))
    return rows.select("query", "query_type", F.coalesce("expected_docs", one, F.array().cast("array<string>")).alias("expected"))


def escaped(value: Column) -> Column:
    """value with the characters that XML keeps for itself as references; null as an empty text."""
    out = F.coalesce(value, F.lit(""))
    for mark, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def graph_lines(triples: DataFrame, form: str = "jsonl", most: int = 300) -> DataFrame:
    """(part, id, line): a graph as lines of jsonl, dot (its first most edges) or graphml, in order of part and id."""
    one = lambda part, text: triples.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("id"), F.lit(text).alias("line"))
    key = F.col("id").cast("string").alias("id")
    if form == "jsonl":
        fields = [c for c in ("subject", "predicate", "object", "valid_from", "valid_to", "source") if c in triples.columns]
        return triples.select(F.lit(1).alias("part"), key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
    source = F.col("source") if "source" in triples.columns else F.lit("")
    if form == "dot":
        quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        edges = triples.orderBy("id").limit(most).select(F.lit(1).alias("part"), key, F.concat(F.lit("  "), quoted("subject"), F.lit(" -> "), quoted("object"), F.lit(" [label="), quoted("predicate"), F.lit("];")).alias("line"))
        return one(0, "digraph facts {").union(edges).union(one(2, "}"))
    if form != "graphml":
        raise ValueError(f"unknown form {form!r}; known are jsonl, dot and graphml")
    names = triples.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    nodes = names.select(F.lit(1).alias("part"), "id", F.concat(F.lit('    <node id="'), escaped(F.col("id")), F.lit('"/>')).alias("line"))
    edge = F.concat(F.lit('    <edge id="e'), escaped(key), F.lit('" source="'), escaped(F.col("subject")), F.lit('" target="'), escaped(F.col("object")), F.lit('"><data key="label">'), escaped(F.col("predicate")), F.lit('</data><data key="source_doc">'), escaped(source), F.lit("</data></edge>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/graphml">\n  <key id="label" for="edge" attr.name="label" attr.type="string"/>\n  <key id="source_doc" for="edge" attr.name="source_doc" attr.type="string"/>\n  <graph id="facts" edgedefault="directed">'
    return one(0, head).union(nodes).union(triples.select(F.lit(2).alias("part"), key, edge.alias("line"))).union(one(3, "  </graph>\n</graphml>"))


def write_graph(triples: DataFrame, path: str, form: str = "jsonl", most: int = 300) -> None:
    """A graph as text files below path, whose names follow the order of their lines."""
    graph_lines(triples, form, most).orderBy("part", "id").select("line").write.mode("overwrite").text(path)
