"""Named queries over text analysis, filters and second-stage retrieval, with SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import markdown as M
from lodeweave.functions import stem as P
from lodeweave.functions import text as T
from lodeweave.operators import filters, graph, kept, planner
from lodeweave.operators import ranking as R
from lodeweave.operators import resampled as Z
from lodeweave.operators import retrieval as X
from lodeweave.operators import similar as Y
from lodeweave.operators import state as S
from lodeweave.plans.catalogue import _POST, _TERMS, _TRIPLES, _WORDS, best, documents, grep_baseline, query, scores_sql, tok, top_sql, triples
from lodeweave.session import stored

# --- queries' texts ---
_ASKED = """(SELECT item_id, ['report q' || (item_id % 4 + 1) || ' ' || (1988 + item_id), 'Q4' || (2000 + item_id) || ' numbers', 'from 1985 to 2001', 'who is Bob in ' || (1980 + item_id), 'rooms 2100 and 2050'][1 + item_id % 5] || ' #Ops tagged Legal about security ' || ['Review of the RFC', 'spec note', 'nothing', 'adrs', '"Big Plan" and ''small one'''][1 + item_id % 5] AS q FROM benchmark)"""


def asked(t):
    def one(values):
        return F.element_at(F.array(*values), (F.col("item_id") % 5 + 1).cast("int"))

    n = F.col("item_id")
    dates = [F.concat(F.lit("report q"), (n % 4 + 1).cast("string"), F.lit(" "), (n + 1988).cast("string")), F.concat(F.lit("Q4"), (n + 2000).cast("string"), F.lit(" numbers")), F.lit("from 1985 to 2001"), F.concat(F.lit("who is Bob in "), (n + 1980).cast("string")), F.lit("rooms 2100 and 2050")]
    kinds = [F.lit(x) for x in ("Review of the RFC", "spec note", "nothing", "adrs", "\"Big Plan\" and 'small one'")]
    return t.benchmark.select("item_id", F.concat(one(dates), F.lit(" #Ops tagged Legal about security "), one(kinds)).alias("q"))


@query(f"""WITH q AS {_ASKED}, m AS (SELECT item_id, regexp_extract(q, '(?i)\\bQ([1-4])\\s*(\\d{{4}})\\b', 1) AS k, regexp_extract(q, '(?i)\\bQ([1-4])\\s*(\\d{{4}})\\b', 2) AS ky, regexp_extract(q, '\\b(\\d{{4}})\\b', 1) AS y FROM q)
SELECT item_id, CASE WHEN k <> '' THEN ky || ['-01', '-04', '-07', '-10'][CAST(k AS INTEGER)] || '-01' WHEN y BETWEEN '1990' AND '2099' THEN y || '-01-01' END AS date_from,
CASE WHEN k <> '' THEN ky || ['-03', '-06', '-09', '-12'][CAST(k AS INTEGER)] || '-31' WHEN y BETWEEN '1990' AND '2099' THEN y || '-12-31' END AS date_to FROM m""")
def query_date_range(t):
    low, high = T.date_range(F.col("q"))
    return asked(t).select("item_id", low.alias("date_from"), high.alias("date_to"))


@query(f"SELECT item_id, 'ops,legal,security' AS tags FROM {_ASKED}")
def query_tags(t):
    return asked(t).select("item_id", F.array_join(T.query_tags(F.col("q")), ",").alias("tags"))


_KINDS = "[" + ", ".join(f"'{k}'" for k in T.DOC_TYPES) + "]"


@query(f"""WITH q AS {_ASKED}, w AS (SELECT item_id, lower(q) AS q, unnest({_KINDS}) AS k FROM q),
f AS (SELECT item_id, k, length(regexp_extract(q, '(?s)^(.*?)\\b' || k || '\\b', 1)) AS place FROM w WHERE regexp_matches(q, '\\b' || k || '\\b'))
SELECT b.item_id, min_by(k, place * 1000 + list_position(list_sort({_KINDS}), k)) AS kind FROM benchmark b LEFT JOIN f ON f.item_id = b.item_id GROUP BY b.item_id""")
def query_type(t):
    return asked(t).select("item_id", T.query_type(F.col("q")).alias("kind"))


@query(f"""WITH q AS {_ASKED}, e AS (SELECT item_id, list_concat(list_concat(regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all(q, '''([^'']+)''', 1)),
  list_concat(list_filter(regexp_split_to_array(q, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{2,}}')), list_filter({tok('q')}, lambda t: length(t) > 4))) AS l FROM q)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS entities FROM e""")
def query_entities(t):
    return asked(t).select("item_id", F.array_join(T.query_entities(F.col("q")), "|").alias("entities"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) <= 200 THEN [0] ELSE range(0, len(w) - 50, 150) END AS s FROM w)
SELECT doc_id, len(s) AS n_windows, s[len(s)] AS last_start FROM s""")
def dense_windows(t):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    made = t.documents.select("doc_id", T.dense_windows(words).alias("c"))
    return made.select("doc_id", F.size("c").cast("long").alias("n_windows"), F.element_at("c", -1)["start"].cast("long").alias("last_start"))


@query()
def time_windows(t):
    said = [F.lit(x) for x in ("what I did two weeks ago and last Friday", "Yesterday, or a couple of days ago", "last weekend", "3 months ago", "past 2 weeks")]
    phrase = F.element_at(F.array(*said), (F.col("item_id") % 5 + 1).cast("int"))
    day = F.date_add(F.lit("2023-05-30").cast("date"), F.col("item_id").cast("int"))
    found = F.transform(T.time_windows(phrase, day), lambda w: F.concat(w["low"].cast("string"), F.lit("/"), w["high"].cast("string")))
    return t.benchmark.select("item_id", F.array_join(found, ",").alias("windows"))


@query()
def stem_terms(t):
    """Document frequency of stems: the analyzer porter+english over the vocabulary."""
    words = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), english=True))).alias("term"))  # a word moves once a text
    return P.stemmed(words).groupBy("term").agg(F.count_distinct("doc_id").alias("df"))


# --- a vault of Markdown made from documents ---
_HEAD = "coalesce(text, '')"
_VAULT = f"""vault AS (SELECT doc_id, lang || '/d' || doc_id || '.md' AS doc_path,
  '---' || chr(10) || 'type: ' || ['Spec', 'rfi', 'note'][1 + doc_id % 3] || chr(10) || 'date: 2026-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10) || chr(10) || 'tags: [ops, #t' || (doc_id % 4) || ']' || chr(10)
  || 'revision: ' || (doc_id % 12) || chr(10) || 'supersedes: ' || lang || '/d' || (doc_id - 7) || '.md' || chr(10) || '---' || chr(10)
  || 'Opening ' || (doc_id % 3) || chr(10) || '# Top ' || doc_id || chr(10) || chr(10) || replace({_HEAD}, '#', '') || chr(10) || '## Part [[d' || (doc_id + 1) || '|next]]' || chr(10) || 'See [prior](' || lang || '/d' || (doc_id - 1) || '.md).' || chr(10)
  || '### Deep' || chr(10) || '## Other' || chr(10) || 'Tail of it all' AS text FROM documents)"""


def vault(t, of=None):
    """Markdown of every document, whole; or of the documents of a table (doc_id) alone."""
    number = F.col("doc_id")
    text = lambda c: c.cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("Spec", "rfi", "note"))), (number % 3 + 1).cast("int"))
    path = lambda n: F.concat("lang", F.lit("/d"), text(n), F.lit(".md"))
    parts = ["---\ntype: ", kind, "\ndate: 2026-0", text(number % 9 + 1), "-1", text(number % 10), "\ntags: [ops, #t", text(number % 4), "]\nrevision: ", text(number % 12), "\nsupersedes: ", path(number - 7), "\n---\nOpening ", text(number % 3), "\n# Top ", text(number), "\n\n", F.translate(F.coalesce("text", F.lit("")), "#", ""), "\n## Part [[d", text(number + 1), "|next]]\nSee [prior](", path(number - 1), ").\n### Deep\n## Other\nTail of it all"]
    made = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    docs = t.documents if of is None else t.documents.join(kept.few(stored(of.select("doc_id").distinct(), "of")), "doc_id", "left_semi")
    return docs.select("doc_id", path(number).alias("doc_path"), made.alias("text")).withColumn("front", M.front_matter(F.col("text"))).select("doc_id", "doc_path", "text", "front.*")


@query(f"""WITH {_VAULT}, b AS (SELECT doc_id, unnest(range(len(l))) AS i, l FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '(?s)^---.*?\\n---', ''), chr(10) || ' '), chr(10)) AS l FROM vault)),
h AS (SELECT doc_id, i, l[i + 1] AS line, regexp_matches(l[i + 1], '^#{{1,6}}\\s+.') AS is_head FROM b),
s AS (SELECT *, CAST(sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n FROM h)
SELECT doc_id, n AS section, coalesce(max(trim(regexp_replace(line, '^#{{1,6}}\\s+', ''))) FILTER (is_head), '') AS heading, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_head), '^\\s+|\\s+$', '', 'g'), '') AS content FROM s GROUP BY doc_id, n""")
def split_sections(t):
    made = vault(t).select("doc_id", F.posexplode(M.sections(F.col("body"))).alias("section", "s"))
    return made.select("doc_id", "section", "s.heading", "s.content")


@query(f"""WITH {_VAULT} SELECT doc_id, 'Top ' || doc_id || ' > Part [[d' || (doc_id + 1) || '|next]] > Deep' AS path, substr(sha256(doc_path || ':section:Deep'), 1, 16) AS section_id FROM vault""")
def section_paths(t):
    made = vault(t).select("doc_id", "doc_path", F.explode(M.sections(F.col("body"))).alias("s")).filter("s.heading = 'Deep'")
    return made.select("doc_id", F.array_join("s.path", " > ").alias("path"), T.short_hash(F.col("doc_path"), F.lit("section"), F.col("s.heading")).alias("section_id"))


@query(f"""WITH {_VAULT}, n AS (SELECT *, regexp_extract(doc_path, '(d\\d+)\\.md$', 1) AS name FROM vault), l AS (SELECT doc_id, doc_path AS source, unnest(['d' || (doc_id + 1), regexp_replace(doc_path, 'd\\d+', 'd' || (doc_id - 1))]) AS link FROM vault)
SELECT DISTINCT source, n.doc_path AS target FROM l JOIN n ON n.name = link OR lower(n.doc_path) = lower(link)""")
def resolve_links(t):
    docs = vault(t)
    links = docs.select(F.col("doc_path").alias("source"), F.explode(T.links(F.col("body"))).alias("link"))
    return X.resolved(links, docs)


_DATED = f"{_VAULT}, f AS (SELECT doc_id, doc_path, ['spec', 'rfi', 'note'][1 + doc_id % 3] AS kind, '2026-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10) AS day, doc_id % 4 AS tag, doc_id % 12 AS revision FROM vault)"


@query(f"WITH {_DATED} SELECT doc_id FROM f WHERE (doc_path LIKE 'en/d%' OR doc_path LIKE 'f_/%') AND NOT regexp_matches(doc_path, '/d[1-3][^/]*$') AND kind IN ('spec', 'note') AND tag = 2 AND day >= '2026-02' AND substr(day, 1, 7) <= '2026-08' AND revision >= 2 AND revision IN (2, 6, 10)")
def filter_metadata(t):
    spec = {"path": ["en/d*", "f?/*"], "exclude_path": "*/d[1-3]*", "type": ["SPEC", "note"], "tags": ["Ops", "#t2"], "tags_any": ["t2", "zzz"], "date_from": "2026-02", "date_to": "2026-08", "meta": {"revision": {"gte": 2, "in": ["2", "06", "10"]}, "owner": {"exists": False}, "supersedes": {"contains": ".MD", "ne": "x"}}}
    return filters.filtered(vault(t), spec).select("doc_id")


@query(f"WITH {_DATED} SELECT a.doc_id FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id + 7 AND b.day <= '2026-05-15' AND a.doc_path = split_part(b.doc_path, '/', 1) || '/d' || a.doc_id || '.md' WHERE a.day <= '2026-05-15' AND b.doc_id IS NULL")
def filter_as_of(t):
    return filters.filtered(vault(t), {"as_of": "2026-05-15"}).select("doc_id")


@query(f"""WITH {_DATED}, q AS (SELECT CAST(day BETWEEN '2026-04-01' AND '2026-06-31' AS INTEGER) + 0.5 * CAST(tag = 2 AS INTEGER) + CAST(kind = 'spec' AS INTEGER) AS score, doc_id FROM f)
SELECT doc_id, score::DOUBLE AS score FROM q WHERE score > 0""")
def structural_scores(t):
    # a tag field is parted by spaces, commas and semicolons only, so that of "[ops, #t2]" the tags are "[ops" and "#t2]"
    docs = vault(t).withColumn("meta", F.map_zip_with("meta", "meta", lambda k, a, b: F.when(k == "tags", F.regexp_replace(a, r"[\[\]#]", "")).otherwise(a)))
    score = X.structural(F.lit("Q2 2026 spec tagged t2 #none"), F.col("meta"))
    return docs.select("doc_id", score.alias("score")).filter("score > 0")


# --- second stage ---
_TOP = f"{_POST}, {_TERMS}, {scores_sql('s', 1.2)}"


@query(f"""WITH {_TOP}, a AS ({top_sql('s', 100)}) SELECT qt.item_id, doc_id, term, round(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS contribution
FROM post JOIN qt USING (term) JOIN vocab USING (term) JOIN a USING (item_id, doc_id)""")
def score_terms(t):
    """Contributions of each query term to the query's 100 best documents."""
    index = documents(t)
    terms = kept.query_terms(t.benchmark, index.analyzer)
    found = index.contributions(terms, index.search(terms, 100))
    return index.named(found, ["doc_id"]).select("item_id", "doc_id", "term", F.round("contribution", 6).alias("contribution"))


@query(f"""WITH {_TOP}, a AS ({top_sql('s', 10)}), w AS (SELECT item_id, doc_id, score / sum(score) OVER (PARTITION BY item_id) AS w FROM a),
r AS (SELECT item_id, term, round(sum(w * tf / dl), 12) AS rel FROM w JOIN post USING (doc_id) GROUP BY ALL),
b AS (SELECT *, rel / sum(rel) OVER (PARTITION BY item_id) AS share FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, term) <= 20)),
o AS (SELECT item_id, term, qtf / sum(qtf) OVER (PARTITION BY item_id) AS own FROM qt)
SELECT coalesce(o.item_id, b.item_id) AS item_id, coalesce(o.term, b.term) AS term, round(0.5 * coalesce(own, 0) + 0.5 * coalesce(share, 0), 6)::DOUBLE AS weight FROM o FULL JOIN b ON o.item_id = b.item_id AND o.term = b.term""")
def rm3_model(t):
    index = documents(t)
    return planner.model(index, kept.query_terms(t.benchmark, index.analyzer)).select("item_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_TOP}, a AS ({top_sql('s', 50)}), i AS (SELECT a.*, doc_id % 9 = 3 AS hit FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY item_id, hit ORDER BY rank) AS place FROM i),
f AS (SELECT item_id, doc_id, rank AS old_rank, round(1.0::DOUBLE / (60 + rank) + CASE WHEN hit THEN 1.0::DOUBLE / (60 + place) ELSE 0 END, 9) AS score FROM p)
SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, old_rank) AS INTEGER) AS rank FROM f""")
def temporal_boost(t):
    """Documents dated in April go up, as for a query that names it."""
    pool = best(t, 50)
    pool = pool.join(vault(t, pool).select("doc_id", "meta"), "doc_id")
    windows = T.time_windows(F.lit("a week ago"), F.lit("2026-04-20").cast("date"))
    day = T.document_date(F.col("meta")["date"])
    inside = F.exists(windows, lambda w: (day >= w["low"]) & (day <= w["high"])) | (F.substring(F.col("meta")["date"], 6, 2) == "04")
    return X.time_boost(pool, inside).select("item_id", "doc_id", "rank")


@query(f"""WITH {_TOP}, a AS ({top_sql('s', 20)}), d AS (SELECT a.item_id, a.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY 1 + doc_id % 9 DESC, doc_id % 10 DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n FROM a)
SELECT item_id, doc_id, round(1 - i / n::DOUBLE, 6) AS score FROM d""")
def recency_signal(t):
    pool = best(t, 20)
    pool = pool.join(vault(t, pool).select("doc_id", F.col("meta")["date"].alias("date")), "doc_id")
    return X.recency(pool).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TOP}, a AS ({top_sql('s', 30)}), l AS (SELECT a.*, lang FROM a JOIN documents USING (doc_id))
SELECT item_id, lang, score, string_agg(doc_id, ',' ORDER BY rank) AS children, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first) AS INTEGER) AS rank
FROM (SELECT item_id, lang, doc_id, rank, max(score) OVER (PARTITION BY item_id, lang) AS score, min(rank) OVER (PARTITION BY item_id, lang) AS first FROM l) GROUP BY item_id, lang, score, first""".replace("CAST(row_number()", "CAST(rank()"))
def parent_groups(t):
    index = documents(t)
    pool = index.named(index.search(kept.query_terms(t.benchmark, index.analyzer), 30), ["doc_id", "lang"])
    return X.parents(pool, parent="lang", child="doc_id")


@query(f"""WITH {_POST}, v AS (SELECT doc_id, term, round(tf / dl::DOUBLE, 4) * (ln((st.n_docs + 1) / (df + 1)::DOUBLE) + 1) AS w FROM post JOIN vocab USING (term), st),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id), q AS (SELECT * FROM v WHERE doc_id % 100 = 0)
SELECT q.doc_id AS doc_a, v.doc_id AS doc_b, round(sum(q.w * v.w) / (any_value(a.norm) * any_value(b.norm)), 4) AS similarity FROM q JOIN v ON q.term = v.term AND q.doc_id <> v.doc_id JOIN n a ON a.doc_id = q.doc_id JOIN n b ON b.doc_id = v.doc_id
GROUP BY 1, 2 HAVING similarity > 0.3""")
def related_docs(t):
    """TF-IDF cosine of every hundredth document with all others."""
    index = documents(t)
    every = Y.vectors(index, "doc_id")
    mine = stored(every.filter("name % 100 = 0"), "mine")
    found = Y.products(mine, every, 0.3001)  # over 0.3, in steps of four digits
    return found.withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


_BAG = f"""bag AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(t) > 0 THEN array_to_string(list_sort(t), ' ') ELSE CAST(doc_id AS VARCHAR) || ' ' END) AS class_id FROM (SELECT doc_id, {tok('text')} AS t FROM documents))"""


@query(f"WITH {_BAG} SELECT doc_id, class_id FROM bag")
def doc_classes(t):
    """Documents whose terms are equal, by the first of them."""
    index = documents(t)
    named = index.named(Y.classes(index), ["doc_id"]).withColumnRenamed("class_pid", "pid").withColumnRenamed("doc_id", "member")
    return index.named(named, ["doc_id"]).select(F.col("member").alias("doc_id"), F.col("doc_id").alias("class_id"))


@query(f"""WITH {_POST}, {_BAG}, v AS (SELECT doc_id, term, round(tf / dl::DOUBLE, 4) * (ln((st.n_docs + 1) / (df + 1)::DOUBLE) + 1) AS w FROM post JOIN vocab USING (term) JOIN bag USING (doc_id), st WHERE doc_id = class_id),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 4) AS similarity FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
GROUP BY 1, 2 HAVING similarity >= 0.5""")
def doc_similarity(t):
    """TF-IDF cosines of at least 0.5 between all classes of equal documents (doc_classes names their members)."""
    index = documents(t)
    first = Y.classes(index).filter("pid = class_pid").select("pid")
    found = Y.products(Y.vectors(index, "doc_id", first), None, 0.5)
    return found.withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


# --- evaluation over samples of the corpus ---
_SYSTEMS, _SAMPLES, _SHARE = {"by_length": (1.2, 0.75), "flat": (1.2, 0.0)}, 10, 0.5
_RESAMPLED = f"""p0 AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pid, {tok('text')} AS t FROM documents),
d AS (SELECT sample, doc_id, pid, t, len(t) AS dl FROM p0, (SELECT unnest(range({_SAMPLES})) AS sample) WHERE substr(md5(pid || ':' || sample), 1, 4) < '8000'),
st AS (SELECT sample, count(*) AS n_docs, avg(dl) AS avgdl FROM d WHERE dl > 0 GROUP BY sample), {_TERMS},
post AS (SELECT sample, doc_id, dl, term, count(*) AS tf FROM (SELECT sample, doc_id, dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
vocab AS (SELECT sample, term, greatest(ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, any_value(avgdl) AS avgdl FROM post JOIN st USING (sample) GROUP BY ALL),
s AS (SELECT sample, system, item_id, doc_id, round(sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - b + b * dl / avgdl))), 6) AS score FROM post JOIN vocab USING (sample, term) JOIN qt USING (term), (VALUES ('by_length', 0.75::DOUBLE), ('flat', 0::DOUBLE)) AS x(system, b) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY sample, system, item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
q AS (SELECT item_id, sample, system, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN d AS m ON m.doc_id = d.doc_id, (VALUES ('by_length'), ('flat')) AS x(system)),
j AS (SELECT q.*, a.rank, row_number() OVER (PARTITION BY q.sample, q.system, q.item_id ORDER BY q.doc_id) AS best FROM q LEFT JOIN a USING (sample, system, item_id, doc_id)),
e AS (SELECT sample, system, item_id, count(rank) / count(*)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS rr, sum(coalesce(1 / log2(rank + 1), 0)) / sum(CASE WHEN best <= 10 THEN 1 / log2(best + 1) ELSE 0 END) AS ndcg FROM j GROUP BY ALL)"""


def resampled(t):
    """Each query's quality in each sample by each system, against the documents that hold the query's text."""
    index = documents(t)
    found = Z.runs(index, kept.query_terms(t.benchmark, index.analyzer), _SYSTEMS, _SAMPLES, _SHARE, 10)
    ids = index.passages().select("doc_id", "pid")
    qrels = grep_baseline(t).join(ids, "doc_id").select("item_id", "pid", F.lit(1).alias("grade"))
    return stored(Z.judged(found, qrels, list(_SYSTEMS), _SAMPLES, _SHARE, 10), "judged")


@query(f"WITH {_RESAMPLED} SELECT sample, system, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM e GROUP BY ALL")
def resampled_quality(t):
    """Ten samples of half the documents, each with statistics of its own, from one read of the asked postings."""
    return Z.averages(resampled(t))


@query(f"""WITH {_RESAMPLED}, w AS (SELECT sample, unnest(['recall', 'rr', 'ndcg']) AS metric, unnest([sum(s * recall) / count(*) * 2, sum(s * rr) / count(*) * 2, sum(s * ndcg) / count(*) * 2]) AS d0 FROM (SELECT *, CASE WHEN system = 'flat' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM e) GROUP BY sample),
z AS (SELECT metric, round(d0, 9) AS d FROM w)
SELECT metric, count(*) AS n_samples, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM z GROUP BY metric""")
def resampled_differences(t):
    """What length normalisation is worth: paired differences on the same samples and queries."""
    return Z.differences(resampled(t), "by_length", "flat")


# --- graph and state ---
@query(f"WITH {_TRIPLES} SELECT count(*) AS triple_count, count(DISTINCT subject) AS entity_count, count(DISTINCT substr(id, 1, 1)) AS source_count FROM tr")
def kg_stats(t):
    return triples(t).agg(F.count(F.lit(1)).alias("triple_count"), F.count_distinct("subject").alias("entity_count"), F.count_distinct(F.substring("id", 1, 1)).alias("source_count"))


@query(f"WITH {_TRIPLES} SELECT substr(id, 1, 1) AS source, count(*) AS n, min(id) AS first_id FROM tr WHERE subject = (SELECT min(n_name) FROM nation) OR object = (SELECT min(n_name) FROM nation) GROUP BY 1")
def kg_entity_sources(t):
    name = t.nation.agg(F.min("n_name")).first()[0]
    return graph.about(triples(t), name).groupBy(F.substring("id", 1, 1).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""WITH n AS (SELECT DISTINCT p_name AS e, lower(trim(p_name)) AS l, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: w <> '')) AS w FROM part)
SELECT a.e AS a, b.e AS b, CASE WHEN a.l = b.l THEN 1.0 WHEN contains(a.l, b.l) OR contains(b.l, a.l) THEN 0.85 ELSE round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE, 6) END::DOUBLE AS similarity
FROM n a JOIN n b ON a.e < b.e WHERE similarity >= 0.75""")
def alias_suggest(t):
    """Pairs of names that may be one. Candidates share a word of their first quarter and one, rarest first, or one's first three characters stand in the other."""
    return graph.alias_pairs(t.part.select(F.col("p_name").alias("e")).distinct())


@query("""WITH x AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, coalesce(value < 150 AND before > 0 AND value > before, false) AS up FROM x), r AS (SELECT *, n - max(CASE WHEN up THEN 0 ELSE n END) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM g)
SELECT user_id, event_id, round(m, 6) AS mean20, CASE WHEN value >= 150 THEN 'critical' WHEN streak >= 3 THEN 'trend' WHEN n >= 5 AND m > 0 AND value > 2 * m THEN 'warning' ELSE 'ok' END AS status FROM r""")
def budget_status(t):
    """The states of token budgets, with thresholds that the events' values reach."""
    return S.budget_status(t.events, "user_id", "event_id", "value", critical=150.0, rounds=3)
