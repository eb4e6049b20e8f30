"""Named queries that read a kept index of passages: ranking, feedback, filters, fused signals and parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import chunks as C
from lodeweave.operators import kept, planner
from lodeweave.operators import retrieval as X
from lodeweave.plans import catalogue
from lodeweave.plans.catalogue import _CUES, _POST, _TERMS, query, scores_sql, tok, top_sql
from lodeweave.plans.knowledge import _PASSAGES
from lodeweave.plans.retrieval import _VAULT, vault


def passages(t, analyzer: str = "plain") -> kept.Index:
    """Passages of the vault by section, kept under an analyzer."""
    return catalogue.kept(t, "passages", lambda: C.of_documents(vault(t)), ["doc_path", "ordinal", "start"], analyzer)


def corpus(t, analyzer: str = "plain") -> planner.Corpus:
    """The vault's passages, documents and links, and a fact for each document: the first longer word of its text is mentioned in it."""
    docs = vault(t)
    edges = X.resolved(docs.select(F.col("doc_path").alias("source"), F.explode(T.links(F.col("body"))).alias("link")), docs.select("doc_path"))
    first = F.get(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 4), F.lit(0))
    path = docs.select("doc_id", "doc_path")
    facts = t.documents.select("doc_id", first.alias("subject")).filter("subject is not null").join(path, "doc_id")
    facts = facts.select(F.col("doc_path").alias("id"), "subject", F.lit("mentioned_in").alias("predicate"), F.col("doc_path").alias("object"), F.col("doc_path").alias("source"), *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_to")))
    return planner.Corpus(passages(t, analyzer), docs, facts, edges)


def asked(t):
    return t.benchmark.select("item_id", "text")


def pointed(t):
    """The items, each with a quarter and a kind of document."""
    return t.benchmark.select("item_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" Q"), (F.col("item_id") % 4 + 1).cast("string"), F.lit(" 2026 spec")).alias("text"))


_OWN = _PASSAGES.replace(f"WITH {_VAULT}, ", "WITH ", 1)
_NUMBERED = f"WITH {_VAULT}, pn AS ({_OWN} SELECT *, row_number() OVER (ORDER BY doc_path, section, start) - 1 AS pid, substr(sha256(doc_path || ':parent:' || section), 1, 16) AS section_id FROM ps)"
_INDEX = f"{_NUMBERED}, {_POST.replace(f'SELECT doc_id, {tok('text')} AS t FROM documents', f'SELECT pid AS doc_id, {tok('content')} AS t FROM pn')}, {_TERMS}, {scores_sql('s', 1.2)}"
_SHOWN = "SELECT item_id, chunk_id, doc_path, score, rank FROM r JOIN pn ON pn.pid = r.doc_id"


def _shown(df):
    return df.select("item_id", "chunk_id", "doc_path", "score", "rank")


@query(f"{_INDEX}, r AS ({top_sql('s', 10)}) {_SHOWN}")
def index_bm25(t):
    """The ten best passages of each item."""
    index = passages(t)
    return _shown(index.named(index.search(kept.query_terms(asked(t), index.analyzer), 10), ["chunk_id", "doc_path"]))


@query(f"{_INDEX} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def index_terms(t):
    """Document and collection frequency of every term of the passages, read beside their lists."""
    return passages(t).vocabulary().select("term", "df", "cf", F.round("idf", 6).alias("idf"))


_PASS = "fm AS (SELECT pid FROM pn WHERE ['spec', 'rfi', 'note'][1 + doc_id % 3] IN ('spec', 'note') AND 1 + doc_id % 9 BETWEEN 2 AND 6 AND doc_id % 4 IN (1, 2))"


@query(f"{_INDEX}, {_PASS}, f AS (SELECT s.* FROM s JOIN fm ON fm.pid = s.doc_id), r AS ({top_sql('f', 5)}) {_SHOWN}")
def retrieve_filtered(t):
    """Passages of documents whose front matter passes; scores of others are never added up."""
    spec = {"type": ["spec", "note"], "date_from": "2026-02", "date_to": "2026-06", "tags_any": ["t1", "t2"]}
    return _shown(planner.retrieve(corpus(t), asked(t), planner.Request(filters=spec)))


_MODEL = f"""a AS ({top_sql('s', 10)}), w AS (SELECT item_id, doc_id, score / sum(score) OVER (PARTITION BY item_id) AS w FROM a),
re AS (SELECT item_id, term, round(sum(w * tf / dl), 12) AS rel FROM w JOIN post USING (doc_id) GROUP BY ALL),
b AS (SELECT *, rel / sum(rel) OVER (PARTITION BY item_id) AS share FROM (SELECT * FROM re QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, term) <= 20)),
o AS (SELECT item_id, term, qtf / sum(qtf) OVER (PARTITION BY item_id) AS own FROM qt),
m AS (SELECT coalesce(o.item_id, b.item_id) AS item_id, coalesce(o.term, b.term) AS term, (0.5 * coalesce(own, 0) + 0.5 * coalesce(share, 0))::DOUBLE AS weight FROM o FULL JOIN b ON o.item_id = b.item_id AND o.term = b.term)"""
_IMPACT = "idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


@query(f"""{_INDEX}, {_MODEL},
c AS (SELECT item_id, doc_id, term, {_IMPACT} AS c FROM post JOIN m USING (term) JOIN vocab USING (term)),
s2 AS (SELECT item_id, doc_id, round(sum(c), 6) AS score FROM c GROUP BY ALL), p1x AS ({top_sql('s', 200)}), p2x AS ({top_sql('s2', 200)}),
po AS (SELECT item_id, doc_id FROM p1x UNION SELECT item_id, doc_id FROM p2x),
f AS (SELECT item_id, doc_id, round(sum(weight * c), 6) AS score FROM po JOIN c USING (item_id, doc_id) JOIN m USING (item_id, term) GROUP BY ALL HAVING score > 0), r AS ({top_sql('f', 5)}) {_SHOWN}""")
def retrieve_rm3(t):
    """The second search of feedback: the best of the query's and of the expanded query's passages by the model's weights."""
    return _shown(planner.retrieve(corpus(t), asked(t), planner.Request(expansion="rm3")))


_ENTITIES = "regexp_extract_all(text, '\"([^\"]+)\"', 1), regexp_extract_all(text, '''([^'']+)''', 1), list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{2,}')), list_filter(" + tok("text") + ", lambda w: length(w) > 4)"


_POINTED = "(SELECT item_id, coalesce(text, '') || ' Q' || (1 + item_id % 4) || ' 2026 spec' AS text FROM benchmark)"


@query(f"""{_INDEX}, a AS ({top_sql('s', 100)}), ad AS (SELECT a.*, pn.doc_path, pn.doc_id AS doc FROM a JOIN pn ON pn.pid = a.doc_id),
bd AS (SELECT item_id, doc_path, doc, doc_id AS pid FROM ad QUALIFY row_number() OVER (PARTITION BY item_id, doc_path ORDER BY rank) = 1),
i AS (SELECT item_id, CASE WHEN g > l THEN 'kg_first' WHEN l > g THEN 'bm25_first' ELSE 'balanced' END AS intent FROM (SELECT item_id, {_CUES(T.GRAPH_CUES)} AS g, {_CUES(T.LEXICAL_CUES)} AS l FROM benchmark)),
ask AS (SELECT DISTINCT item_id, unnest(list_filter(l, lambda x, j: list_position(l, x) = j)[1:8]) AS entity FROM (SELECT item_id, flatten([{_ENTITIES}]) AS l FROM benchmark)),
fa AS (SELECT v.doc_path AS id, list_filter({tok('d.text')}, lambda w: length(w) > 4)[1] AS subject, v.doc_path AS object FROM documents d JOIN vault v USING (doc_id)),
en AS (SELECT subject AS entity, object AS other, id FROM fa WHERE subject IS NOT NULL UNION ALL SELECT object, subject, id FROM fa WHERE subject IS NOT NULL AND subject <> object),
wt AS (SELECT entity, 1 / (1 + count(*))::DOUBLE AS w FROM en GROUP BY entity), ff AS (SELECT entity, other FROM en QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 5),
src AS (SELECT DISTINCT entity AS place, id AS source FROM en), rr AS (SELECT item_id, entity AS place, w FROM ask JOIN wt USING (entity) UNION ALL SELECT item_id, other, 0.3::DOUBLE * w FROM ask JOIN wt USING (entity) JOIN ff USING (entity)),
kg AS (SELECT item_id, source AS doc_path, sum(w) AS score FROM rr JOIN src USING (place) GROUP BY ALL),
ed AS (SELECT DISTINCT x.doc_path AS x, y.doc_path AS y FROM vault x JOIN vault y ON y.doc_id = x.doc_id + 1 UNION SELECT x.doc_path, y.doc_path FROM vault x JOIN vault y ON y.doc_id = x.doc_id - 1 AND split_part(y.doc_path, '/', 1) = split_part(x.doc_path, '/', 1)),
h0 AS (SELECT item_id, doc_path, max(score) AS score FROM ad WHERE rank <= 3 GROUP BY ALL),
h1 AS (SELECT item_id, y AS doc_path, max(score) * 0.4::DOUBLE AS score FROM h0 JOIN ed ON x = doc_path GROUP BY ALL HAVING (item_id, y) NOT IN (SELECT (item_id, doc_path) FROM h0)),
h2 AS (SELECT item_id, y AS doc_path, max(score) * (0.4::DOUBLE * 0.4::DOUBLE) AS score FROM h1 JOIN ed ON x = doc_path GROUP BY ALL HAVING (item_id, y) NOT IN (SELECT (item_id, doc_path) FROM h0 UNION ALL SELECT (item_id, doc_path) FROM h1)),
pop AS (SELECT y AS doc_path, count(*)::DOUBLE AS score FROM ed GROUP BY y),
sx AS (SELECT item_id, pid, 0.0::DOUBLE + CAST(CAST(ceil((1 + doc % 9) / 3.0) AS INTEGER) = 1 + item_id % 4 AS INTEGER) + CAST(doc % 3 = 0 AS INTEGER) AS score FROM bd),
sig AS (SELECT item_id, pid, round(score, 9) AS score, 'kg' AS signal FROM kg JOIN bd USING (item_id, doc_path) UNION ALL SELECT item_id, pid, score, 'links' FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) JOIN bd USING (item_id, doc_path)
  UNION ALL SELECT item_id, pid, score, 'structural' FROM sx UNION ALL SELECT item_id, pid, score, 'link_pop' FROM bd JOIN pop USING (doc_path)),
rk AS (SELECT item_id, pid, signal, row_number() OVER (PARTITION BY item_id, signal ORDER BY score DESC, pid) AS rank FROM sig WHERE score > 0
  UNION ALL SELECT item_id, pid, 'recency', row_number() OVER (PARTITION BY item_id ORDER BY 1 + doc % 9 DESC, doc % 10 DESC, pid) FROM bd UNION ALL SELECT item_id, doc_id, 'bm25', rank FROM a),
v AS (SELECT rk.*, CASE signal WHEN 'bm25' THEN CASE intent WHEN 'kg_first' THEN 0.5 WHEN 'bm25_first' THEN 2.0 ELSE 1.0 END WHEN 'kg' THEN 0.1 * CASE intent WHEN 'kg_first' THEN 2.0 WHEN 'bm25_first' THEN 0.5 ELSE 1.0 END
  WHEN 'links' THEN 0.1 * CASE intent WHEN 'balanced' THEN 1.0 ELSE 0.5 END WHEN 'structural' THEN 0.1 WHEN 'recency' THEN 0.03 ELSE 0.02 END::DOUBLE AS w FROM rk JOIN i USING (item_id)),
fu AS (SELECT item_id, pid, round(sum(w / (60 + rank)), 9) AS rrf FROM v GROUP BY ALL),
r AS (SELECT fu.item_id, fu.pid AS doc_id, a.score, CAST(row_number() OVER (PARTITION BY fu.item_id ORDER BY rrf DESC, fu.pid) AS INTEGER) AS rank FROM fu JOIN a ON a.item_id = fu.item_id AND a.doc_id = fu.pid QUALIFY row_number() OVER (PARTITION BY fu.item_id ORDER BY rrf DESC, fu.pid) <= 10) {_SHOWN}""".replace("FROM benchmark", f"FROM {_POINTED}"))
def retrieve_hybrid(t):
    """A hundred passages of each item, ranked again by facts, links, front matter, dates and inbound links."""
    return _shown(planner.retrieve(corpus(t), pointed(t), planner.Request(k=10, mode="hybrid")))


_WHOLE = f"whole AS ({_OWN} SELECT substr(sha256(doc_path || ':parent:' || section), 1, 16) AS section_id, CASE WHEN heading <> '' AND len(wl) <= 400 OR len(wl) = 0 THEN whole ELSE array_to_string(wl, ' ') END AS content FROM ws)"


@query(f"""{_INDEX}, {_WHOLE}, a AS ({top_sql('s', 20)}), l AS (SELECT a.item_id, a.score, a.rank, pn.chunk_id, pn.section_id, pn.doc_path, CASE WHEN pn.start = 0 THEN 0 ELSE length(array_to_string(string_split(whole.content, ' ')[1:pn.start], ' ')) + 1 END AS low, length(pn.content) AS size FROM a JOIN pn ON pn.pid = a.doc_id JOIN whole USING (section_id)),
g AS (SELECT item_id, section_id, any_value(doc_path) AS doc_path, max(score) AS score, min(rank) AS first, string_agg(chunk_id, ',' ORDER BY rank) AS children, string_agg(low || ':' || (low + size), ',' ORDER BY rank) AS spans FROM l GROUP BY item_id, section_id)
SELECT item_id, section_id AS chunk_id, doc_path, score, children, spans, length(content) AS n_chars, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first) AS INTEGER) AS rank FROM g JOIN whole USING (section_id) QUALIFY rank <= 5""")
def retrieve_sections(t):
    """Sections whole, by their best passage, with where their passages stand."""
    found = planner.retrieve(corpus(t), asked(t), planner.Request(parent="section"))
    return found.select("item_id", "chunk_id", "doc_path", "score", "children", "spans", F.char_length("content").cast("long").alias("n_chars"), "rank")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, length(regexp_extract(text, '^\s*')) AS lead, regexp_extract_all(text, '\S+\s*') AS p FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, lead, p, len(p) AS n, list_filter(range(1, len(p)), lambda i: contains(p[i], chr(10))) AS br FROM d WHERE len(p) > 0),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, CASE WHEN n <= 120 THEN n ELSE coalesce(list_max(list_filter(br, lambda x: x >= 60 AND x <= 120)), 120) END AS stop FROM b
  UNION ALL SELECT r.doc_id, greatest(start + 1, stop - 20), CASE WHEN n <= greatest(start + 1, stop - 20) + 120 THEN n ELSE coalesce(list_max(list_filter(br, lambda x: x >= greatest(start + 1, stop - 20) + 60 AND x <= greatest(start + 1, stop - 20) + 120)), greatest(start + 1, stop - 20) + 120) END FROM r JOIN b USING (doc_id) WHERE stop < n)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(lead + length(array_to_string(p[1:start], '')) AS INTEGER) AS low,
  CAST(lead + length(array_to_string(p[1:start], '')) + length(regexp_replace(array_to_string(p[start + 1:stop], ''), '\s+$', '')) AS INTEGER) AS high FROM r JOIN b USING (doc_id)""")
def line_windows(t):
    """Windows of whole texts that end at line breaks, by words and by characters."""
    each = t.documents.select("doc_id", F.explode(T.bounded_windows(F.col("text"), 120, 20, lines=True)).alias("w"))
    return each.select("doc_id", "w.start", F.col("w.end").alias("stop"), "w.low", "w.high")
