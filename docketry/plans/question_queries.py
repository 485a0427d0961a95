"""Queries over ``benchmark``, ``documents``, ``conversations`` and ``embeddings`` for questions, grading, guards, context and citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import context as X
from docketry.operators import embeddings as EM
from docketry.operators import evaluation as E
from docketry.operators import guards as G
from docketry.operators import questions as Q
from docketry.plans.retrieval_queries import BM25, DENSE, LEADING, asked, candidates, dense, labelled, questions, vectors
from docketry.plans.tables import STOPS_SQL, load, lower_words_sql

RULES = {"thing": [r"thing"], "here": [r"her", r"hat"], "umlaut": [r"[äöü]"], "ion": [r"ion"]}
SETS = {"alpha": ["token"], "beta": ["erth"], "gamma": ["onth"]}
CASES = {r" (?:is|be) ": (("rule: {}", ()), ("exception: {}", ()), ("together: {}", (0, 1)))}


def _tags(text: str, rules: dict) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches({text}, '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in rules.items()) + "], lambda x: x IS NOT NULL)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")


def g6(spark, d):
    return docs(spark, d).select("query_id", F.array_join(G.tag_rules(F.lower("text"), RULES), ",").alias("tags"))


G6 = f"SELECT doc_id AS query_id, array_to_string({_tags('lower(text)', RULES)}, ',') AS tags FROM documents"


def q1(spark, d):
    f = Q.complexity_class(Q.complexity_features(docs(spark, d), RULES, SETS, {"pipe": [r"\|"], "percent": ["%%%"]}), flags=("pipe", "percent"))
    return f.select("query_id", "n_issues", "n_documents", "n_parts", "n_words", F.array_join("reasons", ",").alias("reasons"), "complexity")


_W = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\s\p{Z}]+'), lambda w: w <> ''))"
Q1 = f"""WITH f AS (SELECT doc_id AS query_id, len({_tags("lower(text)", RULES)})::INT AS n_issues, len({_tags("lower(text)", SETS)})::INT AS n_documents,
  greatest(1, len(list_filter(string_split_regex(text, '[?;]'), lambda s: trim(s) <> '')))::INT AS n_parts, {_W}::INT AS n_words, contains(text, '|') AS p, contains(text, '%%%') AS c FROM documents
), r AS (SELECT *, list_filter([CASE WHEN n_issues >= 2 THEN 'issues' END, CASE WHEN n_documents >= 2 THEN 'documents' END, CASE WHEN n_parts >= 2 THEN 'parts' END, CASE WHEN n_words > 40 THEN 'long' END,
    CASE WHEN p THEN 'pipe' END, CASE WHEN c THEN 'percent' END], lambda x: x IS NOT NULL) AS rs FROM f)
SELECT query_id, n_issues, n_documents, n_parts, n_words, array_to_string(rs, ',') AS reasons, CASE WHEN len(rs) >= 2 OR n_documents >= 2 THEN 'COMPLEX' WHEN len(rs) = 1 THEN 'MODERATE' ELSE 'SIMPLE' END AS complexity FROM r"""


def q3(spark, d):
    f = Q.complexity_class(Q.complexity_features(docs(spark, d), RULES, SETS, {"pipe": [r"\|"]}), flags=("pipe",))
    scope = G.scope_check(F.col("text"), ["thing"], {"junk": ["%%%"], "tokens": ["token"]}, ["the"], ["hat"])
    return Q.route_query(f, scope, F.col("text").contains("###")).groupBy("route", "complexity").agg(F.count(F.lit(1)).alias("n"))


Q3 = f"""WITH f AS (SELECT doc_id, text, lower(text) AS l, len({_tags("lower(text)", RULES)}) AS i, len({_tags("lower(text)", SETS)}) AS k, greatest(1, len(list_filter(string_split_regex(text, '[?;]'), lambda s: trim(s) <> ''))) AS p, {_W} AS w FROM documents
), s AS (SELECT *, (i >= 2)::INT + (k >= 2)::INT + (p >= 2)::INT + (w > 40)::INT + contains(text, '|')::INT AS r, contains(l, 'the') AND contains(l, 'hat') AS ours FROM f
), c AS (SELECT *, CASE WHEN r >= 2 OR k >= 2 THEN 'COMPLEX' WHEN r = 1 THEN 'MODERATE' ELSE 'SIMPLE' END AS complexity,
  CASE WHEN contains(l, 'thing') AND w <= 3 THEN 'greeting' WHEN w <= 2 THEN 'ambiguous' WHEN contains(l, '%%%') AND NOT ours THEN 'junk' WHEN contains(l, 'token') AND NOT ours THEN 'tokens' END AS scope FROM s)
SELECT CASE WHEN scope = 'greeting' THEN 'direct' WHEN scope IS NOT NULL THEN 'refusal' WHEN contains(text, '###') THEN 'agent' WHEN complexity = 'COMPLEX' THEN 'decompose' WHEN complexity = 'MODERATE' THEN 'corrective' ELSE 'plain' END AS route,
  complexity, count(*) AS n FROM c GROUP BY ALL"""


def q4(spark, d):
    turns = load(spark, d, "conversations")
    out = Q.resolve_followup(turns, F.length("text") > 100, F.col("text").contains("%%%"), ["^(?:and|und|et) ", "the"], most_words=12)
    return out.select("conv_id", "turn", "is_followup", F.length("previous").alias("previous_length"))


Q4 = f"""WITH u AS (SELECT *, lag(text) OVER w AS p FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(len(p) > 100, false) AND NOT contains(text, '%%%') AND (regexp_matches(lower(text), '^(?:and|und|et) ') OR regexp_matches(lower(text), 'the') OR {_W} <= 12) AS is_followup, len(p)::INT AS previous_length FROM u"""


def subs(spark, d):
    return Q.decompose(questions(spark, d), SETS, r" the ", CASES)


def q5(spark, d):
    return subs(spark, d).select("query_id", "sub_no", F.md5(F.col("sub_query").cast("binary")).alias("digest"), F.size("depends_on").alias("n_dependencies"))


def q6(spark, d):
    return Q.validate_subqueries(questions(spark, d), subs(spark, d))


def q7(spark, d):
    return Q.repair_subqueries(questions(spark, d), subs(spark, d)).select("query_id", "sub_no", F.length("sub_query").alias("length"))


_TERMS = lambda x: f"list_distinct(list_filter({lower_words_sql(x)}, lambda w: len(w) >= 2))"
SUBS = f"""p0 AS (SELECT item_id AS query_id, text, {_tags("lower(text)", SETS)} AS ds, trim(regexp_replace(regexp_replace(text, '(?i)token|erth|onth', '', 'g'), '\\s+', ' ', 'g')) AS bare, strpos(text, ' the ') AS place FROM benchmark
), p1 AS (SELECT query_id, text, CASE WHEN len(ds) >= 2 THEN list_transform(ds, lambda x: x || ': ' || bare) WHEN regexp_matches(text, '(?i) (?:is|be) ') THEN ['rule: ' || text, 'exception: ' || text, 'together: ' || text]
    WHEN place > 0 THEN [trim(substr(text, 1, place - 1)), trim(substr(text, place + 5))] ELSE [text] END AS ps, len(ds) < 2 AS single FROM p0
), subs AS (SELECT query_id, text, single AND len(ps) = 3 AS tied, unnest(range(len(ps)))::INT AS sub_no, unnest(ps) AS sub_query FROM p1
), st AS (SELECT *, {_TERMS("sub_query")} AS t FROM subs
), near AS (SELECT a.query_id, a.sub_no AS first, b.sub_no AS second FROM st a JOIN st b ON a.query_id = b.query_id AND a.sub_no < b.sub_no
    WHERE CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END >= 0.8)"""
Q5 = f"WITH {SUBS} SELECT query_id, sub_no, md5(sub_query) AS digest, CASE WHEN tied AND sub_no = 2 THEN 2 ELSE 0 END::INT AS n_dependencies FROM subs"
Q6 = f"""WITH {SUBS}, q AS (SELECT query_id, any_value(text) AS text, count(*) AS n, string_agg(sub_query, ' ') AS every, bool_or(len(sub_query) < 15) AS short FROM subs GROUP BY query_id
), c AS (SELECT *, {_TERMS("text")} AS t, {_TERMS("every")} AS u FROM q), r AS (SELECT query_id, n, CASE WHEN len(t) > 0 THEN round(len(list_intersect(t, u))::DOUBLE / len(t), 4) ELSE 1 END::DOUBLE AS coverage, short, query_id IN (SELECT query_id FROM near) AS redundant FROM c)
SELECT *, NOT short AND NOT redundant AND coverage >= 0.6 AS valid FROM r"""
Q7 = f"""WITH {SUBS}, k AS (SELECT * FROM subs WHERE (query_id, sub_no) NOT IN (SELECT (query_id, second) FROM near)), h AS (SELECT query_id, min(sub_no) AS first, string_agg(sub_query, ' ') AS every FROM k GROUP BY query_id
), u AS (SELECT query_id, first, {_TERMS("every")} AS u FROM h), l AS (SELECT k.query_id, sub_no, sub_query, sub_no = first AS leads, list_filter({_TERMS("text")}, lambda w: NOT list_contains(u, w)) AS lost FROM k JOIN u ON k.query_id = u.query_id)
SELECT query_id, sub_no, (len(sub_query) + CASE WHEN leads AND len(lost) > 0 THEN len(array_to_string(lost, ' ')) + 1 ELSE 0 END)::INT AS length FROM l"""


def q8(spark, d):
    parts = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("sub_no"), F.array((F.col("l_linenumber") - 1).cast("int")).alias("depends_on"))
    parts = parts.withColumn("depends_on", F.when(F.col("sub_no") > 1, F.col("depends_on")).when(F.col("query_id") % 5 == 0, F.array("sub_no")).otherwise(F.array().cast("array<int>")))
    return Q.dag_valid(parts)


Q8 = """WITH n AS (SELECT l_orderkey AS q, l_linenumber AS s FROM lineitem), bad AS (SELECT DISTINCT q FROM n WHERE (s > 1 AND (q, s - 1) NOT IN (SELECT (q, s) FROM n)) OR (s = 1 AND q % 5 = 0))
SELECT DISTINCT q AS query_id, q NOT IN (SELECT q FROM bad) AS valid FROM n"""


def g9(spark, d):
    return G.pre_guard(asked(spark, d), dense(spark, d), 0.5).select("query_id", "n", "top", "refuse")


G9 = f"WITH {DENSE} SELECT query_id, count(*) AS n, max(score) AS top, max(score) < 0.5 AS refuse FROM dense GROUP BY query_id"


def g13(spark, d):
    return G.retrieval_confidence(asked(spark, d), dense(spark, d))


G13 = f"""WITH {DENSE}, t AS (SELECT query_id, max(score) AS m FROM dense GROUP BY query_id), l AS (SELECT vec_id AS query_id, CASE WHEN m IS NULL THEN 'EMPTY' WHEN m >= 0.7 THEN 'HIGH' WHEN m >= 0.45 THEN 'AMBIGUOUS' ELSE 'LOW' END AS level
  FROM embeddings LEFT JOIN t ON vec_id = query_id WHERE vec_id % 25 = 0)
SELECT *, CASE level WHEN 'AMBIGUOUS' THEN 'corrective' WHEN 'LOW' THEN 'decompose' WHEN 'EMPTY' THEN 'decompose' END AS escalate FROM l"""


def g14(spark, d):
    q = asked(spark, d)
    weak = G.pre_guard(q, dense(spark, d), 0.6).filter("refuse").select("query_id", F.lit("low_score").alias("reason"))
    named = q.filter("label = 3").select("query_id", F.lit("named").alias("reason"))
    return G.apply_gates(q, [named, weak])


G14 = f"""WITH {DENSE}, t AS (SELECT query_id, query_label, max(score) AS m FROM dense GROUP BY ALL)
SELECT query_id, CASE WHEN query_label = 3 THEN 1 WHEN m < 0.6 THEN 2 END AS refused_by, CASE WHEN query_label = 3 THEN 'named' WHEN m < 0.6 THEN 'low_score' END AS reason FROM t"""


def g5(spark, d):
    rows = dense(spark, d).join(vectors(spark, d).select("doc_id", "label"), "doc_id")
    scored = rows.select("query_id", F.col("score").alias("sem"), (F.col("label") / 10.0).alias("subject"), (F.col("rank") <= 3).cast("double").alias("issue"), (F.col("doc_id") % 2).cast("double").alias("condition"),
                         F.when(F.col("doc_id") % 7 == 0, 0.8).otherwise(1.0).alias("in_force"), (F.col("label") != F.col("query_id") % 10).alias("mismatch"))
    return G.evidence_gate(asked(spark, d), scored)


G5 = f"""WITH {DENSE}, s AS (SELECT query_id, score, label, CASE WHEN doc_id % 7 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE * (0.25 * score + 0.25 * (label / 10.0::DOUBLE) + 0.3 * (rank <= 3)::INT + 0.2 * (doc_id % 2)) AS s FROM dense
), p AS (SELECT query_id, max(s) AS b, avg((s >= 0.55)::INT) AS c, bool_and(label <> query_id % 10) AS off, max(score) AS t FROM s GROUP BY query_id
), g AS (SELECT query_id, round(b, 4)::DOUBLE AS best, round(least(1.0, b + 0.15 * c), 4)::DOUBLE AS gate_score, off, t FROM p)
SELECT query_id, best, gate_score, NOT (off AND t < 0.78) AND gate_score >= 0.5 AS passed, CASE WHEN off AND t < 0.78 THEN 'issue_mismatch' WHEN gate_score < 0.5 THEN 'low_evidence' END AS reason FROM g"""


def g1(spark, d):
    return G.grade_chunks(candidates(spark, d), out_of_scope=["licensed"]).select("query_id", "doc_id", "grade_score", "grade")


def g2(spark, d):
    return G.grade_query(questions(spark, d), G.grade_chunks(candidates(spark, d), out_of_scope=["licensed"]))


def g8(spark, d):
    return G.resolve_named_documents(docs(spark, d), [("token", "t", True), (r"\|", "pipe", False), ("%%%", "junk", True)])


G8 = "SELECT doc_id AS query_id, CASE WHEN contains(text, '|') THEN 'pipe' WHEN contains(text, 'token') THEN 't' ELSE 'junk' END AS document, contains(text, '|') AS refused FROM documents WHERE contains(text, '|') OR contains(text, 'token') OR contains(text, '%%%')"


def evidence(spark, d):
    """Benchmark passages as answers, their best document as context."""
    c = candidates(spark, d)
    return c.withColumn("t", F.row_number().over(E.W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))).filter("t = 1").select(F.col("query_id").alias("answer_id"), F.col("query").alias("answer"), F.col("content").alias("context"))


def g11(spark, d):
    return G.verify_claims(evidence(spark, d))


def g12(spark, d):
    return G.align_answer(evidence(spark, d)).select("answer_id", F.length("answer").alias("length"), "refused")


# a break ends a claim: a mark in its place stands for the look-behind that DuckDB's patterns lack
_CLAIMS = r"list_filter(list_transform(string_split(regexp_replace(answer, '([.!?\n])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda s: len(s) >= 15 AND NOT suffix(s, ':'))"


def m7(spark, d):
    return evidence(spark, d).select("answer_id", E.faithfulness(F.col("answer"), F.col("context"), F.lit(False)).alias("f")).select("answer_id", "f.*")


def _ev(body: str) -> str:
    return f"""WITH {BM25}, e AS (SELECT query_id AS answer_id, b.text AS answer, lower(d.text) AS context FROM bm25 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank = 1){body}"""


_LONG = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= 3)"
M7 = _ev(
    r""", mp AS (SELECT *, list_filter(list_transform(string_split_regex(answer, '[.\n;]'), lambda s: trim(s)), lambda s: len(s) > 15) AS ps FROM e
), mq AS (SELECT answer_id, context, CASE WHEN len(ps) > 0 THEN ps ELSE [trim(answer)] END AS ps FROM mp), mu AS (SELECT answer_id, context, unnest(ps) AS s FROM mq), mw AS (SELECT answer_id, context, """
    + _LONG.format("s")
    + r""" AS ws FROM mu), mr AS (SELECT answer_id, avg((len(ws) > 0 AND len(list_filter(ws, lambda x: contains(context, x))) / len(ws)::DOUBLE >= 0.7)::INT) AS ratio FROM mw GROUP BY answer_id)
SELECT answer_id, CASE WHEN ratio >= 0.75 THEN 'SUPPORTED' WHEN ratio >= 0.4 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status, CASE WHEN ratio >= 0.75 THEN 1.0 WHEN ratio >= 0.4 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, round(ratio, 4) AS support_ratio FROM mr"""
)


G11 = _ev(
    f""", c AS (SELECT answer_id, context, {_CLAIMS} AS cs FROM e), u AS (SELECT answer_id, context, unnest(cs) AS s FROM c), w AS (SELECT answer_id, context, s, {_LONG.format("s")} AS ws, regexp_extract_all(lower(s), '\\d+(?:[\\d.,]*\\d)?') AS ns,
    regexp_extract_all(lower(s), 'điều\\s+(\\d+[a-zA-Z]*)', 1) AS refs FROM u
), r AS (SELECT answer_id, len(list_filter(refs, lambda x: NOT list_contains(regexp_extract_all(context, 'điều\\s+(\\d+[a-zA-Z]*)', 1), x))) > 0 AS wrong,
    len(ws) = 0 OR (len(list_filter(ws, lambda x: contains(context, x)))::DOUBLE / len(ws) >= 0.4 AND len(list_filter(ns, lambda x: NOT contains(context, x))) = 0) AS held FROM w
), per AS (SELECT answer_id, count(*)::INT AS n, count(*) FILTER (held AND NOT wrong)::INT AS k, count(*) FILTER (wrong)::INT AS x FROM r GROUP BY answer_id
), a AS (SELECT e.answer_id, coalesce(n, 0)::INT AS n_claims, coalesce(k, 0)::INT AS n_entailed, coalesce(x, 0)::INT AS n_contradicted, trim(answer) = '' OR trim(context) = '' AS blank FROM e LEFT JOIN per ON e.answer_id = per.answer_id
), s AS (SELECT *, CASE WHEN blank THEN 0 WHEN n_claims = 0 THEN 1 ELSE round(n_entailed::DOUBLE / n_claims, 4) END::DOUBLE AS score FROM a)
SELECT answer_id, n_claims, n_entailed, n_contradicted, score, CASE WHEN blank THEN 'BLOCK_REFUSAL' WHEN n_claims = 0 THEN 'ALLOW' WHEN n_contradicted > 0 OR score < 0.4 THEN 'BLOCK_REFUSAL' WHEN score < 0.65 THEN 'ADD_DISCLAIMER' ELSE 'ALLOW' END AS action FROM s"""
)
G12 = _ev(
    f""", c AS (SELECT answer_id, context, {_CLAIMS} AS cs FROM e), u AS (SELECT answer_id, context, unnest(cs) AS s, unnest(range(len(cs))) AS i FROM c), w AS (SELECT answer_id, context, s, i, {_LONG.format("s")} AS ws FROM u
), k AS (SELECT answer_id, string_agg(s, ' ' ORDER BY i) AS answer FROM w WHERE len(list_filter(ws, lambda x: contains(context, x)))::DOUBLE / greatest(len(ws), 1) >= 0.35 OR regexp_matches(s, '\\d+\\s*[x×*/]\\s*\\d+') GROUP BY answer_id)
SELECT e.answer_id, coalesce(len(k.answer), 0)::INT AS length, k.answer IS NULL AS refused FROM e LEFT JOIN k ON e.answer_id = k.answer_id"""
)

_SH = lambda terms, text: f"CASE WHEN len({terms}) > 0 THEN len(list_filter({terms}, lambda x: contains({text}, x)))::DOUBLE / len({terms}) ELSE 0.0::DOUBLE END"
GRADED = f"""{BM25}, c0 AS (SELECT query_id, doc_id, greatest(0, least(1, score))::DOUBLE AS raw, b.text AS query, {lower_words_sql("b.text")} AS ws, lower({LEADING}) AS title, lower(d.text) AS content
  FROM bm25 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10
), c1 AS (SELECT *, list_distinct(list_filter(ws, lambda w: len(w) >= 2 AND NOT list_contains({STOPS_SQL}, w))) AS singles,
    list_distinct(list_transform(list_filter(range(1, len(ws)), lambda i: NOT list_contains({STOPS_SQL}, ws[i]) AND NOT list_contains({STOPS_SQL}, ws[i + 1])), lambda i: ws[i] || ' ' || ws[i + 1])) AS pairs FROM c0
), c2 AS (SELECT *, {_SH("pairs", "title")} AS pt, {_SH("pairs", "content")} AS pc, {_SH("singles", "content")} AS sc,
    len(list_intersect(regexp_extract_all(query, '(?i)điều\\s*(\\d+)', 1), regexp_extract_all(title || ' ' || content, '(?i)điều\\s*(\\d+)', 1))) > 0 AS named FROM c1
), c3 AS (SELECT *, CASE WHEN contains(lower(query), 'licensed') THEN 'outside' WHEN named THEN 'named' WHEN pt >= 0.5 OR (pc >= 0.5 AND sc >= 0.6) THEN 'strong' WHEN pc >= 0.25 OR (len(pairs) = 0 AND sc >= 0.5) THEN 'part' WHEN pt + pc + sc = 0 THEN 'nothing' ELSE 'weak' END AS rule FROM c2
), c4 AS (SELECT query_id, doc_id, rule, round(CASE rule WHEN 'outside' THEN raw * 0.35::DOUBLE WHEN 'named' THEN greatest(raw, 0.85::DOUBLE) WHEN 'strong' THEN least(1.0::DOUBLE, greatest(0.7::DOUBLE, 0.35::DOUBLE * raw + 0.4::DOUBLE * pc + 0.25::DOUBLE * pt))
    WHEN 'part' THEN 0.5::DOUBLE * raw + 0.5::DOUBLE * pc WHEN 'nothing' THEN raw * 0.4::DOUBLE ELSE 0.4::DOUBLE * raw + 0.6::DOUBLE * (sc * 0.5::DOUBLE) END, 4) AS grade_score FROM c3
), graded AS (SELECT query_id, doc_id, grade_score, CASE WHEN rule IN ('named', 'strong') OR (rule = 'part' AND grade_score >= 0.68) THEN 'CORRECT' WHEN rule IN ('part', 'weak') AND grade_score >= 0.45 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS grade FROM c4)"""
G1 = f"WITH {GRADED} SELECT * FROM graded"
G2 = f"""WITH {GRADED}, g AS (SELECT query_id, count(*) FILTER (grade = 'CORRECT') AS n_correct, count(*) FILTER (grade = 'AMBIGUOUS') AS n_ambiguous, max(grade_score) AS confidence FROM graded GROUP BY query_id
), f AS (SELECT item_id AS query_id, coalesce(n_correct, 0)::BIGINT AS n_correct, coalesce(n_ambiguous, 0)::BIGINT AS n_ambiguous, coalesce(confidence, 0)::DOUBLE AS confidence FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN g ON item_id = query_id)
SELECT *, CASE WHEN n_correct > 0 AND confidence >= 0.68 THEN 'REFINE' WHEN n_correct + n_ambiguous > 0 THEN 'COMBINE_SEARCH' WHEN confidence >= 0.45 THEN 'WEB_SEARCH' ELSE 'REFUSE' END AS action FROM f"""


def x3(spark, d):
    strips = X.split_strips(candidates(spark, d), heading=r"^\p{Lu}\p{Ll}+\.$")
    kept = X.filter_strips(strips, heading=r"^\p{Lu}\p{Ll}+\.$")
    return kept.select("query_id", "doc_id", "strip_no", "strip_score", "is_heading")


def x4(spark, d):
    rows = candidates(spark, d).withColumns({"full_length": F.length("content"), "rank": F.row_number().over(E.W.partitionBy("query_id").orderBy("doc_id"))})
    return X.recompose(X.filter_strips(X.split_strips(rows))).select("query_id", F.length("context").alias("length"), "n_sources", "compression")


def x5(spark, d):
    c = candidates(spark, d).withColumn("rank", F.row_number().over(E.W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")))
    return X.pack_context(c.select("query_id", "doc_id", "rank", "content"), 1500).select("query_id", "doc_id", "rank", "tokens", "included")


X5 = f"""WITH {BM25}, c AS (SELECT query_id, doc_id, rank, ceil(len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{{Z}}]+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT AS tokens FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 10
), u AS (SELECT *, sum(tokens + 5) OVER (PARTITION BY query_id ORDER BY rank) - 5 <= 1500 AS ok FROM c) SELECT query_id, doc_id, rank, tokens, bool_and(ok) OVER (PARTITION BY query_id ORDER BY rank) AS included FROM u"""


def x9(spark, d):
    """Answers with tags to parts of an order; an order has as many sources as lines."""
    answers = load(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("a [SOURCE 1] b [SOURCE "), (F.col("o_orderkey") % 9).cast("string"), F.lit("] c")).alias("text"))
    sources = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("<"), "l_partkey", F.lit("$>")).alias("citation"))
    sources = sources.groupBy("answer_id", "n").agg(F.min("citation").alias("citation"))
    return X.resolve_citations(answers, sources).select("answer_id", "text", F.array_join("resolved", ",").alias("resolved"), F.array_join("invalid", ",").alias("invalid"))


X9 = """WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, min('<' || l_partkey || '$>') AS c FROM lineitem GROUP BY ALL), k AS (SELECT o_orderkey AS o, o_orderkey % 9 AS n FROM orders)
SELECT k.o AS answer_id, 'a ' || coalesce(a.c, '') || ' b ' || coalesce(b.c, '') || ' c' AS text, concat_ws(',', CASE WHEN a.n IS NOT NULL THEN 1 END, CASE WHEN k.n <> 1 THEN b.n END) AS resolved,
  concat_ws(',', CASE WHEN a.n IS NULL THEN 1 END, CASE WHEN b.n IS NULL AND k.n <> 1 THEN k.n END) AS invalid FROM k LEFT JOIN s a ON a.o = k.o AND a.n = 1 LEFT JOIN s b ON b.o = k.o AND b.n = k.n"""


def m4_m5(spark, d):
    """Whole passages as answers, the whole text of their best document as reference; every fifth must be refused."""
    b = evidence(spark, d).withColumnRenamed("answer_id", "item_id")
    refused, refuse = F.col("item_id") % 7 == 0, F.col("item_id") % 5 == 0
    out = E.answer_correctness(F.col("answer"), F.col("context"), F.array(F.lit("doc_Điều 9")), F.array(F.concat(F.lit("Điều "), (F.col("item_id") % 12).cast("string"))), refused, refuse)
    return b.select("item_id", out.alias("c")).select("item_id", "c.*")


_KWS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda w: len(w) >= 2 AND NOT list_contains(stops, w)))"
M4_M5 = _ev(
    f""", st AS (SELECT string_split('{" ".join(E.ANSWER_STOP_WORDS)}', ' ') AS stops), k AS (SELECT answer_id AS item_id, answer_id % 7 = 0 AS refused, answer_id % 5 = 0 AS refuse, {_KWS.format("answer")} AS a, {_KWS.format("context")} AS b FROM e, st
), f AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS c, (item_id % 12 = 9)::INT::DOUBLE AS r FROM k), g AS (SELECT *, CASE WHEN c > 0 THEN 2 * ((c / len(a)) * (c / len(b))) / (c / len(a) + c / len(b)) ELSE 0 END AS f1 FROM f
), s AS (SELECT *, CASE WHEN refuse THEN CASE WHEN refused THEN 'CORRECT' ELSE 'INCORRECT' END WHEN refused THEN 'INCORRECT' WHEN r >= 1 AND f1 >= 0.2 THEN 'CORRECT' WHEN r > 0 OR f1 >= 0.35 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS status FROM g)
SELECT item_id, status, CASE status WHEN 'CORRECT' THEN 1.0 WHEN 'PARTIALLY_CORRECT' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, CASE WHEN refuse AND refused THEN 1.0 WHEN refuse OR refused THEN 0.0 ELSE round(f1, 4) END::DOUBLE AS f1_score,
  CASE WHEN refuse AND refused THEN 1.0 WHEN refuse OR refused THEN 0.0 ELSE r END::DOUBLE AS article_recall FROM s"""
)


def records(spark, d):
    """Labelled documents as answer records: quality as gold, a rule as prediction, errors as refusals."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    guess = (~F.col("text").rlike(r"[|$%&#]|!!")).cast("int")
    return rows.select("doc_id", "lang", "source", "quality", "toxic", guess.alias("guess"), (F.col("toxic") == 1).alias("refused"), F.when(F.col("quality") == guess, 1.0).when(F.col("lang") == "en", 0.5).otherwise(0.0).alias("score"), F.col("n_chars").cast("double").alias("size"))


REC = "rec AS (SELECT doc_id, lang, source, quality, toxic, (NOT regexp_matches(text, '[|$%&#]|!!'))::INT AS guess, toxic = 1 AS refused, n_chars::DOUBLE AS size FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, CASE WHEN quality = guess THEN 1.0 WHEN lang = 'en' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM rec)"


def m8(spark, d):
    return records(spark, d).select("doc_id", E.refusal_outcome(F.col("refused"), F.col("quality") == 0).alias("outcome"))


M8 = f"WITH {REC} SELECT doc_id, CASE WHEN quality = 0 AND refused THEN 'TRUE_REFUSAL' WHEN quality = 0 THEN 'FALSE_ANSWER' WHEN refused THEN 'FALSE_REFUSAL' ELSE 'TRUE_ANSWER' END AS outcome FROM r"


def m10(spark, d):
    out = E.grouped_metrics(records(spark, d), ["lang"], ["score", "size"], answerable=F.col("quality") == 1)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M10 = f"""WITH {REC} SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_answerable, round(avg(refused::INT) FILTER (quality <> 1), 6) AS refusal_accuracy, round(avg(1 - refused::INT) FILTER (quality <> 1), 6) AS false_answer_rate,
  round(avg(score) FILTER (quality = 1), 6) AS mean_score, round(avg(size) FILTER (quality = 1), 6) AS mean_size FROM r GROUP BY lang"""


def m17(spark, d):
    out = E.confusion_metrics(records(spark, d), "quality", "guess")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M17 = f"""WITH {REC}, k AS (SELECT DISTINCT quality AS c FROM r UNION SELECT DISTINCT guess FROM r), p AS (SELECT c, (SELECT count(*) FROM r WHERE quality = c) AS support, (SELECT count(*) FROM r WHERE guess = c) AS predicted, (SELECT count(*) FROM r WHERE quality = c AND guess = c) AS hit FROM k
), q AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS re FROM p), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM q)
SELECT c::VARCHAR AS class, support, predicted, hit AS right, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round((sum(hit) OVER () / sum(support) OVER ())::DOUBLE, 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM f"""


def m18(spark, d):
    rows = records(spark, d).withColumns({"long": F.col("size") > 2000, "good": F.col("quality") == 1, "hit": F.col("quality") == F.col("guess")})
    out = E.conditional_rates(rows, ["source"], ["long", "good", "hit"], of={"hit": "good"})
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M18 = f"WITH {REC} SELECT source, count(*) AS n, round(avg((size > 2000)::INT), 6) AS rate_long, round(avg((quality = 1)::INT), 6) AS rate_good, round(avg((quality = guess)::INT) FILTER (quality = 1), 6) AS rate_hit FROM r GROUP BY source"


def m23(spark, d):
    out = E.score_distribution(records(spark, d), ["lang"], "score", F.col("quality") == 1)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M23 = f"""WITH {REC} SELECT lang, count(*) FILTER (score = 1) AS n_full, count(*) FILTER (score = 0.5) AS n_half, count(*) FILTER (score = 0) AS n_zero, round(avg((score > 0)::INT), 6) AS share_above_zero, round(avg(score) FILTER (quality = 1), 6) AS mean_answerable,
  round(avg(score), 6) AS mean_all FROM r GROUP BY lang"""


def e4(spark, d):
    v = vectors(spark, d).select("doc_id", "label")
    new = v.filter("doc_id % 3 = 0").select((F.col("doc_id") + 100).alias("doc_id"), (F.col("label") + 10).alias("label"), F.lit(1).alias("seq"))
    new = new.unionByName(new.filter("doc_id % 2 = 0").select("doc_id", (F.col("label") + 10).alias("label"), F.lit(2).alias("seq")))
    return EM.upsert_vectors(v, new)


E4 = """WITH n AS (SELECT vec_id + 100 AS doc_id, label + 10 + CASE WHEN (vec_id + 100) % 2 = 0 THEN 10 ELSE 0 END AS label FROM embeddings WHERE vec_id % 3 = 0)
SELECT doc_id, label::INT AS label FROM n UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM n)"""


def e6(spark, d):
    return EM.candidate_pool(vectors(spark, d).select("doc_id", "label"), asked(spark, d).select(F.col("query_id").alias("doc_id")), 100)


E6 = "SELECT doc_id, label FROM (SELECT vec_id AS doc_id, label, row_number() OVER (ORDER BY (vec_id % 25 = 0) DESC, md5('42:' || vec_id), vec_id) AS t FROM embeddings) WHERE doc_id % 25 = 0 OR t <= 100"


def e7(spark, d):
    """Of the retrieved vectors, those of the query's label are positives, those of label 9 negatives of all other queries."""
    found = labelled(spark, d).withColumn("model", F.lit("a"))
    pairs = lambda c: found.filter(c).select("query_id", "doc_id")
    out = EM.compare_embeddings(found, pairs("label = query_label"), pairs("label = 9 AND query_label <> 9"), found.select("model", "query_id", "doc_id", "score"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


E7 = f"""WITH {DENSE}, p AS (SELECT query_id, min(rank) FILTER (label = query_label) AS f, count(*) FILTER (label = query_label AND rank <= 5) AS n FROM dense GROUP BY query_id)
SELECT 'a' AS model, round(avg(coalesce((f <= 1)::INT, 0)), 6) AS hit_1, round(avg(coalesce((f <= 3)::INT, 0)), 6) AS hit_3, round(avg(coalesce((f <= 5)::INT, 0)), 6) AS hit_5, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE / f ELSE 0 END), 6) AS mrr,
  round(avg(n / 5.0::DOUBLE), 6) AS precision_5, round((SELECT avg(score) FROM dense WHERE label = query_label) - (SELECT avg(score) FROM dense WHERE label = 9 AND query_label <> 9), 6) AS margin FROM p"""

QUERIES = {
    "e4_upsert_vectors": (e4, E4), "e6_candidate_pool": (e6, E6), "e7_compare_embeddings": (e7, E7), "g1_grade_chunks": (g1, G1), "g2_grade_query": (g2, G2), "g5_evidence_gate": (g5, G5), "g6_tag_rules": (g6, G6), "g8_named_documents": (g8, G8),
    "g9_pre_guard": (g9, G9), "g11_verify_claims": (g11, G11), "g12_align_answer": (g12, G12), "g13_confidence": (g13, G13), "g14_apply_gates": (g14, G14), "m4_m5_answer_correctness": (m4_m5, M4_M5), "m7_faithfulness": (m7, M7), "m8_refusal_outcome": (m8, M8),
    "m10_overall_metrics": (m10, M10), "m17_confusion": (m17, M17), "m18_conditional_rates": (m18, M18), "m23_score_distribution": (m23, M23), "q1_q2_complexity": (q1, Q1), "q3_route": (q3, Q3), "q4_followup": (q4, Q4), "q5_decompose": (q5, Q5),
    "q6_validate_subqueries": (q6, Q6), "q7_repair_subqueries": (q7, Q7), "q8_dag_valid": (q8, Q8), "x3_filter_strips": (x3, None), "x4_recompose": (x4, None), "x5_pack_context": (x5, X5), "x9_resolve_citations": (x9, X9),
}
