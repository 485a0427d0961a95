"""Further queries: dates and rewriting of questions, appendix units, citations, logs, search modes and evidence status, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import text as T
from docketry.operators import context as X
from docketry.operators import embeddings as EM
from docketry.operators import evaluation as E
from docketry.operators import guards as G
from docketry.operators import questions as Q
from docketry.operators import retrieval as R
from docketry.operators import structure as S
from docketry.operators import validation as V
from docketry.plans.corpus_queries import BESIDE, INTRO, LINES, SUFFIX, gold, headings, lines, questions
from docketry.plans.history_queries import LOG, log
from docketry.plans.evidence_queries import bm25_of
from docketry.plans.retrieval_queries import _KW, _LW, BM25, DENSE, asked, candidates, dense, docs, vectors
from docketry.plans.retrieval_queries import questions as passages
from docketry.plans.tables import STOPS_SQL, load
from docketry.sources import corpus as C


def r2(spark, d):
    """Share of the exact five nearest that random projections find, per query."""
    exact = dense(spark, d, 5).select("query_id", "doc_id")
    near = R.dense_topk_lsh(asked(spark, d), vectors(spark, d), 6).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def r4(spark, d):
    kept = R.metadata_filter(load(spark, d, "documents"), lang="fr", source="src1")
    return R.bm25_topk(passages(spark, d), kept.select("doc_id", "text"), 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


R4 = f"""WITH {BM25.replace("FROM documents)", "FROM documents WHERE lang = 'fr' AND source = 'src1')", 1)} SELECT query_id, count(*) AS n FROM bm25 WHERE rank <= 5 GROUP BY query_id"""


def r12(spark, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, "quy định hiện nay").when(k == 1, F.concat(F.lit("từ Ngày "), F.date_format(day, "d"), F.lit(" tháng "), F.date_format(day, "M"), F.lit(" năm "), F.date_format(day, "yyyy")))
        .when(k == 2, F.concat(F.lit("vào "), F.date_format(day, "dd/MM/yyyy"))).when(k == 3, F.concat(F.lit("tháng "), F.date_format(day, "M/yyyy"))).otherwise(F.concat(F.lit("năm "), F.date_format(day, "yyyy")))
    )
    return load(spark, d, "orders").select("o_orderkey", D.temporal_intent(text, F.lit("2024-06-01").cast("date")).alias("day"))


R12 = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-06-01' WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN date_trunc('month', o_orderdate)::DATE ELSE make_date(year(o_orderdate), 12, 31) END AS day FROM orders"""


def r15(spark, d):
    """Passages with terms of a dictionary added, flags of ambiguity, and a rewritten form."""
    t = F.col("text")
    return passages(spark, d).select(
        "query_id", F.length(Q.expand_query(t, {"tion": ["alpha one", "beta"], "erth": ["gamma"]}, polite="^The ")).alias("expanded"), Q.flag_ambiguous(t, ["tion"], ["erth"]).alias("ambiguous"),
        F.length(Q.rewrite_query(t, "^The ", r"\.$", {"the": "a"}, "subject")).alias("rewritten"),
    )


R15 = r"""WITH b AS (SELECT item_id, regexp_replace(text, '^The ', '') AS t, trim(regexp_replace(regexp_replace(text, '^The ', ''), '\.$', '')) AS u, lower(text) AS l FROM benchmark)
SELECT item_id AS query_id, (len(trim(t)) + CASE WHEN contains(lower(t), 'tion') AND contains(lower(t), 'erth') THEN 21 WHEN contains(lower(t), 'tion') THEN 15 WHEN contains(lower(t), 'erth') THEN 6 ELSE 0 END)::INT AS expanded,
  contains(l, 'tion') AND NOT contains(l, 'erth') AS ambiguous, (len(u) - 2 * len(list_filter(regexp_split_to_array(lower(u), '[^\p{L}\p{N}_]+'), lambda w: w = 'the')) + 8)::INT AS rewritten FROM b"""


def r21(spark, d):
    out = R.improved_retrieval("V4", passages(spark, d), load(spark, d, "documents").select("doc_id", "text"), 5, expand=lambda t: Q.expand_query(t, {"erth": ["onth"]}))
    return out.select("query_id", "doc_id", "score", "rank")


R21 = f"""WITH {BM25}, e AS (SELECT item_id, trim(text) || CASE WHEN contains(lower(text), 'erth') AND NOT contains(lower(text), 'onth') THEN ' onth' ELSE '' END AS text FROM benchmark), {bm25_of("e", "2")}, c AS (
  SELECT query_id, doc_id, score, {_LW} AS w, {_KW.replace("X", "d.text")} AS dk, lower(d.text) AS content FROM bm252 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20
), p AS (SELECT *, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM c
), s AS (SELECT * EXCLUDE (score), round(greatest(0, least(1, 0.45 * least(1.0, len(list_filter(runs, lambda x: contains(content, x))) * 0.25) + 0.2 * score)), 6)::DOUBLE AS score FROM p
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS t FROM s) WHERE t <= 5
), k AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i AND NOT list_contains({STOPS_SQL}, x)) AS asked FROM best
), g AS (SELECT query_id, doc_id, score FROM k WHERE len(list_intersect(asked, dk)) >= 1 AND (score >= 0.25 OR len(list_filter(range(1, len(asked)), lambda i: contains(content, asked[i] || ' ' || asked[i + 1]))) > 0))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM g"""


def d4(spark, d):
    marked = headings(spark, d).withColumn("kind", F.when(F.col("kind") == "section", "appendix").otherwise(F.col("kind"))).withColumn("number", F.lit(None).cast("string"))
    return S.flag_appendix_start(marked, 3, INTRO, r"^(Of|Und|En|Et) ", SUFFIX).filter("appendix_start").select("doc_id", "line_no")


D4 = f"""WITH {BESIDE}, c AS (SELECT *, max((kind = 'chapter')::INT) OVER (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c,
  max((kind = 'article')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS a FROM intro)
SELECT doc_id, line_no FROM c WHERE kind = 'section' AND a = 1 AND coalesce(c, 0) = 0 AND NOT introduced AND NOT (unfinished AND regexp_matches(b, '(?:khoản|điều|điểm|mẫu)\\s+\\d*$'))
  AND NOT regexp_matches(trim(regexp_replace(line, '^(Of|Und|En|Et) ', '')), '{SUFFIX}') AND NOT coalesce(regexp_matches(n, '^(?:\\d+\\.\\s+|[a-zđ]\\)\\s+|\\p{{Ll}})'), false)"""


def d12(spark, d):
    return S.forms(lines(spark, d), r"^(The|Der|La|De) ", 50).select("doc_id", "seq", "part", F.size(F.split("content", " ")).alias("n_words"))


D12 = f"""WITH {LINES}, u AS (SELECT *, sum(regexp_matches(line, '^(The|Der|La|De) ')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS u FROM lines
), g AS (SELECT doc_id, u, len(string_split(string_agg(line, ' ' ORDER BY line_no), ' ')) AS n FROM u GROUP BY doc_id, u), s AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY u) - 1)::INT AS seq FROM g
), p AS (SELECT doc_id, seq, n, unnest(range(0, (n - 1) // 50 + 1))::INT AS part FROM s) SELECT doc_id, seq, part, least(50, n - 50 * part)::INT AS n_words FROM p"""


def d13(spark, d):
    return S.catalog(lines(spark, d), r"^(The|Der) ", r"^(Of|Und) ", r"^\p{Lu}", 3).select("doc_id", F.md5(F.col("sector").cast("binary")).alias("sector"), "unit", "last_entry")


D13 = f"""WITH {LINES}, k AS (SELECT *, regexp_matches(line, '^(The|Der) ') AS s, regexp_matches(line, '^(Of|Und) ') AS t, regexp_matches(line, '^\\p{{Lu}}')::INT AS e FROM lines
), c AS (SELECT *, last_value(CASE WHEN s THEN line END IGNORE NULLS) OVER w AS sector, sum(s::INT) OVER w AS sn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), r AS (SELECT *, sum(t::INT) OVER (PARTITION BY doc_id, sn ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS tn FROM c), n AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, sn, tn ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM r WHERE NOT s AND NOT t)
SELECT doc_id, md5(any_value(sector)) AS sector, ((n - 1) // 3)::INT AS unit, max(n)::BIGINT AS last_entry FROM n WHERE n > 0 GROUP BY doc_id, sn, tn, (n - 1) // 3"""


def d14(spark, d):
    return S.word_limited_units(lines(spark, d), F.col("line").rlike("^The "), 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"))


def m6(spark, d):
    """Orders as answers that cite parts; the parts of the order are retrieved, those with a quantity over 25 are gold."""
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.collect_set(F.concat(F.lit("part"), "l_partkey", F.lit("."))).alias("got"), F.collect_set(F.when(F.col("l_quantity") > 25, F.concat(F.lit("part"), "l_partkey", F.lit(".")))).alias("gold"), F.min("l_partkey").alias("a"))
    cited = F.array(F.concat(F.lit("[Part "), "a", F.lit(".]")), F.concat(F.lit("[Part "), F.col("a") + 1, F.lit(".]")))
    out = E.citation_metrics(cited, F.col("got"), F.col("gold"), F.col("answer_id") % 9 == 0, F.col("answer_id") % 2 == 0)
    return li.select("answer_id", out.alias("c")).select("answer_id", "c.*")


M6 = """WITH a AS (SELECT l_orderkey AS o, min(l_partkey) AS a FROM lineitem GROUP BY 1), c AS (SELECT o, unnest([a, a + 1]) AS p FROM a
), h AS (SELECT o, p, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o AND l_partkey = p) AS v, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o AND l_partkey = p AND l_quantity > 25) AS g FROM c
), s AS (SELECT o, o % 9 = 0 AS refused, (o % 2 = 0)::INT::DOUBLE AS safe, sum(v::INT) AS v, sum((v AND g)::INT) AS g FROM h GROUP BY o)
SELECT o AS answer_id, CASE WHEN refused THEN 0 ELSE 2 END AS total, (CASE WHEN refused THEN 0 ELSE v END)::INT AS valid, (CASE WHEN refused THEN 0 ELSE g END)::INT AS gold_matching, CASE WHEN refused THEN safe ELSE 1.0 END::DOUBLE AS coverage,
  CASE WHEN refused THEN safe ELSE g / 2.0 END::DOUBLE AS precision, CASE WHEN refused THEN safe ELSE (v = 2 AND g > 0)::INT END::DOUBLE AS accuracy, CASE WHEN refused THEN 0 ELSE (2 - v) / 2.0 END::DOUBLE AS invalid_rate FROM s"""


def m9(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderkey") % 3, (F.col("o_orderkey") % 4 == 0).alias("got"), (F.col("o_orderkey") % 5 == 0).alias("refused"), (F.col("o_orderkey") % 10 == 0).alias("must"), (F.col("o_orderkey") % 7).alias("c"), (F.col("o_orderkey") % 3 == 0).alias("right"))
    kind = E.error_type(F.when(F.col("right"), "CORRECT").otherwise("INCORRECT"), F.col("got"), F.col("c") / 6.0, F.col("refused"), F.col("must"))
    return rows.select(F.coalesce(kind, F.lit("none")).alias("error_type")).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


M9 = """SELECT CASE WHEN (o_orderkey % 5 = 0) <> (o_orderkey % 10 = 0) THEN 'REFUSAL' WHEN o_orderkey % 10 = 0 THEN 'none' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN 'RETRIEVAL' WHEN o_orderkey % 3 <> 0 THEN 'GENERATION'
  WHEN o_orderkey % 7 < 6 THEN 'CITATION' ELSE 'none' END AS error_type, count(*) AS n FROM orders GROUP BY 1"""


def m16(spark, d):
    """Two models over days, one test for each of two metrics."""
    rows = log(spark, d).groupBy("model_name", F.to_date("ts").alias("day")).agg(F.max("total_latency_ms").alias("latency"), F.sum("total_tokens").cast("double").alias("tokens"))
    long = rows.unpivot(["model_name", "day"], ["latency", "tokens"], "metric", "value")
    out = E.paired_test(long, "day", "model_name", "value", "m0", "m2", by=["metric"])
    return out.select("metric", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t_statistic", 6).alias("t_statistic"), F.round("cohens_d", 6).alias("cohens_d"))


M16 = f"""WITH {LOG}, l AS (SELECT model_name, ts::DATE AS day, max(total_latency_ms) AS latency, sum(total_tokens)::DOUBLE AS tokens FROM log GROUP BY ALL), u AS (SELECT model_name, day, 'latency' AS metric, latency AS v FROM l UNION ALL SELECT model_name, day, 'tokens', tokens FROM l
), p AS (SELECT a.metric, a.v - b.v AS d FROM u a JOIN u b ON a.metric = b.metric AND a.day = b.day WHERE a.model_name = 'm0' AND b.model_name = 'm2')
SELECT metric, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM p GROUP BY metric"""


def x7(spark, d):
    part = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Khoản ").otherwise(""), "l_linenumber"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.format_citation(F.lit("Luật"), F.col("l_partkey").cast("string"), part, F.lit(None).cast("string")).alias("citation")).distinct()


X7 = "SELECT DISTINCT l_orderkey, l_linenumber, '[Luật, Điều ' || l_partkey || CASE WHEN l_linenumber % 3 > 0 THEN ', Khoản ' || l_linenumber ELSE '' END || ']' AS citation FROM lineitem"


def x6(spark, d):
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    subs = candidates(spark, d).select("query_id", (F.col("doc_id") % 2).cast("int").alias("sub_no"), F.concat(F.lit("part "), F.col("doc_id") % 2).alias("sub_query"), place.alias("rank"), "content")
    return X.sectioned_context(subs).select("query_id", F.length("context").alias("length"))


def e5(spark, d):
    return EM.get_by_id(vectors(spark, d), [1, 5, 250]).select("doc_id", "label")


E5 = "SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (1, 5, 250)"


def e3(spark, d):
    rows = load(spark, d, "embeddings").select(F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("vector"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model"))
    return EM.check_compat(rows, spark.createDataFrame([(64, "m0")], "dimension int, model string"))


E3 = "SELECT * FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN 60 ELSE 64 END AS dimension, 'm' || (vec_id % 2) AS model, count(*) AS n FROM embeddings GROUP BY 1, 2) WHERE dimension <> 64 OR model <> 'm0'"


def s9(spark, d):
    rows = log(spark, d).select(F.col("id").cast("string").alias("question_id"), "query", "answer", "is_refused", "route_taken", "total_latency_ms")
    part = lambda k: rows.filter(F.col("question_id").cast("long") % 3 == k)
    out = C.unify_logs(part(0).drop("route_taken"), part(1).drop("route_taken").withColumn("rewritten_query", F.upper("query")), part(2))
    return out.select("question_id", "system", "route_taken", F.array_join("sub_queries", ",").alias("sub_queries"))


S9 = f"WITH {LOG} SELECT id::VARCHAR AS question_id, ['plain', 'corrective', 'adaptive'][id % 3 + 1] AS system, CASE WHEN id % 3 = 2 THEN route_taken END AS route_taken, CASE WHEN id % 3 = 1 THEN upper(query) END AS sub_queries FROM log"


def s11(spark, d):
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("citations"))
    return C.parse_history_json(rows, ["citations"]).select("event_id", F.array_join("citations", "|").alias("citations"))


S11 = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a|' || event_type ELSE '' END AS citations FROM events"


def v9(spark, d):
    known = docs(spark, d).select("doc_id")
    return V.question_status(questions(spark, d), gold(spark, d), known, vectors(spark, d).select("doc_id"))


V9 = """WITH g AS (SELECT item_id, item_id * 37 AS doc_id FROM benchmark WHERE item_id % 5 <> 0), c AS (SELECT item_id, bool_and(doc_id IN (SELECT doc_id FROM documents)) AS a, bool_and(doc_id IN (SELECT vec_id FROM embeddings)) AS b FROM g GROUP BY item_id)
SELECT b.item_id AS query_id, CASE WHEN NOT c.b THEN 'INDEX_MISMATCH' WHEN NOT c.a THEN 'CORPUS_MISMATCH' WHEN (b.item_id % 4 = 0) = (c.item_id IS NOT NULL) THEN 'INVALID' ELSE 'VALID' END AS status FROM benchmark b LEFT JOIN c ON b.item_id = c.item_id"""


def g3(spark, d):
    rows = dense(spark, d).join(vectors(spark, d).select("doc_id", "label"), "doc_id").select("query_id", "doc_id", F.col("score").alias("coverage"), (F.col("label") % 2 == 0).alias("conditions_met"))
    return G.evidence_status(asked(spark, d), rows)


G3 = f"""WITH {DENSE}, r AS (SELECT query_id, score, score >= 0.5 AND label % 2 = 0 AS full_, score >= 0.25 AS part FROM dense), q AS (SELECT query_id, count(*) FILTER (full_) AS f, count(*) FILTER (part) AS p, max(score) AS m FROM r GROUP BY query_id)
SELECT query_id, f AS n_full, p AS n_partial, CASE WHEN f > 0 THEN 'SUFFICIENT' WHEN p > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status, round(m, 4) AS confidence FROM q"""

QUERIES = {
    "r2_dense_topk_lsh": (r2, None), "r4_metadata_filter": (r4, R4), "r12_temporal_intent": (r12, R12), "r15_r17_expand_and_rewrite": (r15, R15), "r21_improved_retrieval": (r21, R21), "d4_appendix_start": (d4, D4), "d12_forms": (d12, D12), "d13_catalog": (d13, D13),
    "d14_word_limited_units": (d14, None), "m6_citation_metrics": (m6, M6), "m9_error_type": (m9, M9), "m16_significance_table": (m16, M16), "x6_sectioned_context": (x6, None), "x7_format_citation": (x7, X7), "e3_check_compat": (e3, E3), "e5_get_by_id": (e5, E5), "s9_unify_logs": (s9, S9),
    "s11_parse_history_json": (s11, S11), "v9_question_status": (v9, V9), "g3_evidence_status": (g3, G3),
}
