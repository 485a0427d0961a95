"""Queries of gold sources, titles, hybrid search, first hits, guards, expansion by a table and exact quantiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import context as X
from docketry.operators import guards as G
from docketry.operators import questions as Q
from docketry.operators import quantiles as N
from docketry.operators import retrieval as R
from docketry.plans.corpus_queries import trim
from docketry.plans.retrieval_queries import BM25, DENSE, dense, docs, questions, vectors
from docketry.plans.tables import load, lower_words_sql
from docketry.sources import corpus as C


def s3(spark, d):
    """Passages as questions with one or two gold sources, of which every third has no chunks."""
    i = F.col("item_id")
    source = lambda doc, article, chunks: F.struct(doc.cast("string").alias("document_id"), article.cast("string").alias("article_number"), chunks.cast("array<string>").alias("chunk_ids"))
    gold = F.when(i % 3 == 0, F.array(source(i % 5, F.lit(None), F.lit(None)), source(i % 7, i % 2, F.array(i, i + 1, i)))).otherwise(F.array(source(i % 7, i % 2, F.array(i, i + 1, i))))
    return C.explode_gold(load(spark, d, "benchmark").select(i.alias("question_id"), gold.alias("gold_sources")))


S3 = """SELECT item_id AS question_id, (item_id % 7)::VARCHAR AS document_id, (item_id % 2)::VARCHAR AS article_number, unnest([item_id, item_id + 1])::VARCHAR AS chunk_id FROM benchmark
UNION ALL SELECT item_id, (item_id % 5)::VARCHAR, NULL, NULL FROM benchmark WHERE item_id % 3 = 0"""


def c8(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.official_title(F.col("text"), F.lit("Luật"), F.col("doc_id").cast("string"), r"^([^\n]*)\n").cast("binary")).alias("digest"))


_HEAD = trim("regexp_extract(substr(coalesce(text, ''), 1, 2500), '^([^\\n]*)\\n', 1)")
_TITLE = trim(f"regexp_replace(regexp_replace({_HEAD}, '[\\s\\p{{Z}}]+', ' ', 'g'), '^\\([^)]+\\)\\s*', '')")
C8 = f"SELECT doc_id, md5({trim(f'''concat_ws(' ', 'Luật', 'số ' || doc_id, nullif({_TITLE}, ''))''')}) AS digest FROM documents"


def r10(spark, d):
    asked = questions(spark, d).join(vectors(spark, d).select(F.col("doc_id").alias("query_id"), "vector"), "query_id")
    return R.retrieve("hybrid", asked, docs(spark, d), vectors(spark, d).select("doc_id", "vector"), 5).select("query_id", "doc_id", "score", "rank")


R10 = f"""WITH {BM25}, near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)
), lists AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near UNION ALL SELECT query_id, doc_id, rank FROM bm25 WHERE query_id IN (SELECT vec_id FROM embeddings)
), f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS f FROM lists WHERE rank <= 20 GROUP BY ALL), s AS (SELECT query_id, doc_id, round(f / max(f) OVER (PARTITION BY query_id), 6) AS score FROM f)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 5"""


def r19(spark, d):
    """The first query that finds each document, by rank and then by its number."""
    rows = dense(spark, d).select("query_id", "doc_id", "score", (F.col("rank").cast("long") * 1_000_000_000 + F.col("query_id")).alias("place"))
    return R.dedup_keep_first(rows, ["doc_id"], "place").select("doc_id", "query_id", "score")


R19 = f"WITH {DENSE} SELECT doc_id, query_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, query_id) AS t FROM dense) WHERE t = 1"


def g10(spark, d):
    """Passages that cite two numbered sources, of which one may be there; every sixth cites none."""
    i = F.col("item_id")
    tag = lambda n: F.concat(F.lit("[SOURCE "), n.cast("string"), F.lit("]"))
    answers = load(spark, d, "benchmark").select(i.alias("answer_id"), F.when(i % 6 == 0, F.col("text")).otherwise(F.concat("text", tag(i % 4), F.lit(" and "), tag(i % 3))).alias("text"))
    sources = load(spark, d, "benchmark").select(i.alias("answer_id"), (i % 5).cast("int").alias("n"), F.lit("[A]").alias("citation"))
    return G.post_guard(X.resolve_citations(answers, sources)).select("answer_id", F.size("resolved").alias("n_resolved"), F.size("invalid").alias("n_invalid"), "refuse")


G10 = """WITH t AS (SELECT item_id, CASE WHEN item_id % 6 = 0 THEN [] ELSE list_distinct([item_id % 4, item_id % 3]) END AS tags FROM benchmark
), r AS (SELECT item_id AS answer_id, len(list_filter(tags, lambda n: n = item_id % 5))::INT AS n_resolved, len(tags)::INT AS n FROM t)
SELECT answer_id, n_resolved, (n - n_resolved)::INT AS n_invalid, n_resolved = 0 AND n > 0 AS refuse FROM r"""

IDLE, CONTEXT, WORD = ("the", "la", "die"), "General Law", "tion"


def r15_table(spark, d):
    """Passages expanded by a dictionary of all documents: their first two words say the next two."""
    ws = T.lower_words(F.col("text"))
    entries = docs(spark, d).select(F.col("doc_id").alias("entry"), F.array_join(F.slice(ws, 1, 2), " ").alias("key"), F.slice(ws, 3, 2).alias("terms"))
    out = Q.expand_questions(questions(spark, d), entries, {"A": ["erth"], "B": ["que "]}, (r"^the\s", r"^and\s"), idle=IDLE, context=CONTEXT, context_word=WORD)
    return out.select("query_id", "search", F.md5(F.col("rewritten").cast("binary")).alias("rewritten"), F.size("terms").alias("n_terms"), F.array_join("documents", ",").alias("documents"))


R15_TABLE = f"""WITH dict AS (SELECT doc_id AS entry, array_to_string(ws[1:2], ' ') AS key, ws[3:4] AS terms FROM (SELECT doc_id, {lower_words_sql("text")} AS ws FROM documents)
), q AS (SELECT item_id, text, {lower_words_sql("text")} AS ws, trim(regexp_replace(trim(regexp_replace(trim(text), '(?i)^the\\s', '')), '(?i)^and\\s', '')) AS bare FROM benchmark
), g AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS key FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM q, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
), h AS (SELECT item_id, flatten(list(terms ORDER BY entry)) AS terms FROM g JOIN dict USING (key) WHERE key <> '' GROUP BY item_id
), p AS (SELECT q.*, coalesce(h.terms, []) AS terms, list_filter([CASE WHEN contains(lower(text), 'erth') THEN 'A' END, CASE WHEN contains(lower(text), 'que ') THEN 'B' END], lambda x: x IS NOT NULL) AS documents FROM q LEFT JOIN h USING (item_id)
), a AS (SELECT *, list_concat(documents, terms[1:6], list_filter(regexp_extract_all(bare, '[\\p{{L}}\\p{{N}}_]+'), lambda t: len(t) >= 2 AND lower(t) NOT IN ('the', 'la', 'die'))[1:5]) AS ps FROM p
), b AS (SELECT *, CASE WHEN len(list_filter(ps, lambda x: contains(lower(x), '{WORD}'))) > 0 THEN ps ELSE list_append(ps, '{CONTEXT}') END AS ps2 FROM a)
SELECT item_id AS query_id, array_to_string(list_filter(ps2, lambda x, i: list_position(list_transform(ps2, lambda y: lower(y)), lower(x)) = i), ' ') AS search, md5(CASE WHEN len(terms) > 0 THEN bare || ' (' || array_to_string(terms[1:3], ', ') || ')' ELSE bare END) AS rewritten,
  len(terms)::INT AS n_terms, array_to_string(documents, ',') AS documents FROM b"""


def nq(spark, d):
    rows = load(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return N.index_quantiles(rows, ["l_returnflag"], "v", {"p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0})


_P = lambda q, name: f"min(v) FILTER (i = least(floor({q} * n), n - 1)) AS {name}"
NQ = f"""WITH r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, {_P(0.25, "p25")}, {_P(0.5, "p50")}, {_P(0.95, "p95")}, {_P(1.0, "p100")} FROM r GROUP BY l_returnflag"""

QUERIES = {
    "s3_explode_gold": (s3, S3), "c8_official_title": (c8, C8), "r10_hybrid_retrieve": (r10, R10), "r19_dedup_keep_first": (r19, R19), "g10_post_guard": (g10, G10), "r15_expand_by_table": (r15_table, R15_TABLE), "nq_exact_quantiles": (nq, NQ),
}
