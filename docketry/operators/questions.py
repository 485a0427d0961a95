"""Query understanding over tables of questions and conversations. Rule sets are data; defaults hold the structure only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import extract_references, lower_words, once, words
from docketry.operators.guards import matches_any, tag_rules

#: Rules of a question set: label -> patterns (issues, documents) and groups of patterns.
Rules = Mapping[str, Sequence[str]]


def complexity_features(questions: DataFrame, issues: Rules, documents: Rules, cues: Rules) -> DataFrame:
    """Q1: rows (query_id, text) with arrays ``issues``, ``documents``, ``articles``, counts of each, ``n_words``, ``n_parts`` (question marks and ``;``), and one boolean for each of
    ``cues`` (such as condition, calculation, procedure, comparison, time).
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    out = questions.select("query_id", "text", tag_rules(text, issues).alias("issues"), tag_rules(text, documents).alias("documents"), extract_references(F.col("text")).alias("articles"),
                           *[matches_any(text, ps).alias(f"has_{name}") for name, ps in cues.items()])
    parts = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[?;]"), lambda s: F.trim(s) != "")))
    return out.withColumns({"n_issues": F.size("issues"), "n_documents": F.size("documents"), "n_articles": F.size("articles"), "n_words": F.size(words(F.col("text"))), "n_parts": parts})


def complexity_class(features: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Q2: add ``reasons`` and ``complexity``: COMPLEX with two or more reasons, or two documents, MODERATE with one, else SIMPLE."""
    reasons = [F.when(F.col("n_issues") >= 2, "issues"), F.when(F.col("n_documents") >= 2, "documents"), F.when(F.col("n_articles") >= 2, "articles"), F.when(F.col("n_parts") >= 2, "parts"), F.when(F.col("n_words") > 40, "long")]
    reasons += [F.when(F.col(f"has_{f}"), F.lit(f)) for f in flags]
    out = features.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("complexity", F.when((F.size("reasons") >= 2) | (F.col("n_documents") >= 2), "COMPLEX").when(F.size("reasons") == 1, "MODERATE").otherwise("SIMPLE"))


def route_query(classified: DataFrame, scope: Column, calculation: Column) -> DataFrame:
    """Q3: add ``route``: refusal (out of scope), direct (a greeting), agent (a calculation), decompose (complex), corrective (moderate), plain."""
    route = F.when(scope == "greeting", "direct").when(scope.isNotNull(), "refusal").when(calculation, "agent").when(F.col("complexity") == "COMPLEX", "decompose").when(F.col("complexity") == "MODERATE", "corrective")
    return classified.withColumn("route", F.coalesce(route, F.lit("plain")))


def resolve_followup(turns: DataFrame, in_scope: Column, out_of_scope: Column, patterns: Sequence[str], most_words: int = 6) -> DataFrame:
    """Q4: user rows (conv_id, turn, text) with ``previous`` and ``is_followup``: the user's turn before was in scope, this one is not out of scope, and it fits a pattern or has at most ``most_words`` words."""
    users = turns.filter("role = 'user'").withColumns({"_in": in_scope, "_out": out_of_scope})
    w = W.partitionBy("conv_id").orderBy("turn")
    users = users.withColumns({"previous": F.lag("text").over(w), "_was": F.lag("_in").over(w)})
    short = F.size(words(F.col("text"))) <= most_words
    follows = F.coalesce(F.col("_was"), F.lit(False)) & ~F.coalesce(F.col("_out"), F.lit(False)) & (matches_any(F.lower("text"), patterns) | short)
    return users.withColumn("is_followup", follows).drop("_in", "_out", "_was")


#: Pattern -> parts of a question that has it: a template with ``{}`` for the question, and the numbers of the parts it depends on.
Cases = Mapping[str, Sequence[tuple[str, Sequence[int]]]]


def decompose(questions: DataFrame, documents: Rules, compound: str, cases: Cases | None = None, most: int = 4) -> DataFrame:
    """Q5: (query_id, sub_no, sub_query, depends_on) by the first case that fits.

    Two or more documents: one part each, the topic without their names; two or more articles: one for each of the first two and a third that depends on both; one of
    ``cases`` (such as contrasts or a change over time): its parts, the first case that occurs; a compound sentence (pattern ``compound`` between the parts): its two parts; else the question itself. A question has ``most`` parts at most. Null texts count as empty.
    """
    questions = questions.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower("text")
    docs, arts = tag_rules(low, documents), extract_references(F.col("text"))
    bare = F.col("text")
    for patterns in documents.values():
        for p in patterns:
            bare = F.regexp_replace(bare, f"(?iu){p}", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    sub = lambda text, deps: F.struct(text.alias("sub_query"), deps.alias("depends_on"))
    none = F.array().cast("array<int>")
    by_doc = F.transform(docs, lambda x: sub(F.concat(x, F.lit(": "), bare), none))
    by_art = F.concat(
        F.transform(F.slice(arts, 1, 2), lambda a: sub(F.concat(F.lit("Điều "), a, F.lit(": "), F.col("text")), none)),
        F.array(sub(F.concat(F.col("text"), F.lit(" ("), F.array_join(F.slice(arts, 1, 2), ", "), F.lit(")")), F.array(F.lit(0), F.lit(1)))),
    )
    deps = lambda ns: F.array(*map(F.lit, ns)).cast("array<int>")
    filled = lambda template: F.concat(*[p for k, piece in enumerate(template.split("{}")) for p in ([F.col("text")] if k else []) + [F.lit(piece)]])
    by_case = [(F.col("text").rlike(f"(?iu){p}"), F.array(*[sub(filled(t), deps(ns)) for t, ns in ps])) for p, ps in (cases or {}).items()]
    halves = F.split(F.col("text"), compound, 2)
    by_half = F.transform(halves, lambda h: sub(F.trim(h), none))
    parts = F.when(F.size(docs) >= 2, by_doc).when(F.size(arts) >= 2, by_art)
    for there, given in by_case:
        parts = parts.when(there, given)
    parts = parts.when(F.size(halves) == 2, by_half).otherwise(F.array(sub(F.col("text"), none)))
    return questions.select("query_id", F.posexplode(F.slice(parts, 1, most)).alias("sub_no", "s")).select("query_id", "sub_no", "s.sub_query", "s.depends_on")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(lower_words(text), lambda w: F.length(w) >= 2))


def similar_pairs(subs: DataFrame, least: float = 0.80) -> DataFrame:
    """Q6: (query_id, first, second) of sub-queries of one question whose words have Jaccard ``least`` or more; a question has few sub-queries, so its pairs are few. Two without words are alike."""
    rows = subs.select("query_id", F.struct("sub_no", _terms(F.col("sub_query")).alias("t")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    pairs = F.flatten(F.transform("ss", lambda a: F.transform(F.filter("ss", lambda b: b["sub_no"] > a["sub_no"]), lambda b: F.struct(
        a["sub_no"].alias("first"), b["sub_no"].alias("second"), F.coalesce(F.try_divide(F.size(F.array_intersect(a["t"], b["t"])), F.size(F.array_union(a["t"], b["t"]))), F.lit(1.0)).alias("jaccard")))))
    return rows.select("query_id", F.explode(pairs).alias("p")).filter(F.col("p.jaccard") >= least).select("query_id", "p.first", "p.second")


def validate_subqueries(questions: DataFrame, subs: DataFrame, least_chars: int = 15, least_coverage: float = 0.60, similar: float = 0.80) -> DataFrame:
    """Q6: (query_id, n, coverage, short, redundant, valid): the share of the question's words in its parts, and whether all are long enough, different and cover it."""
    per = subs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.collect_list("sub_query")).alias("all"), F.bool_or(F.length("sub_query") < least_chars).alias("short"))
    rows = questions.select("query_id", "text").join(per, "query_id").join(similar_pairs(subs, similar).select("query_id").distinct().withColumn("redundant", F.lit(True)), "query_id", "left")
    terms = _terms(F.col("text"))
    coverage = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, _terms(F.col("all")))) / F.size(terms)).otherwise(1.0)
    out = rows.select("query_id", "n", F.round(coverage, 4).alias("coverage"), "short", F.coalesce("redundant", F.lit(False)).alias("redundant"))
    return out.withColumn("valid", ~F.col("short") & ~F.col("redundant") & (F.col("coverage") >= least_coverage))


def repair_subqueries(questions: DataFrame, subs: DataFrame, similar: float = 0.80) -> DataFrame:
    """Q7: without parts that are near-duplicates of an earlier one; words of the question that no part holds are added to the first part."""
    later = similar_pairs(subs, similar).select("query_id", F.col("second").alias("sub_no")).distinct()
    kept = subs.join(later, ["query_id", "sub_no"], "left_anti")
    held = kept.groupBy("query_id").agg(_terms(F.concat_ws(" ", F.collect_list("sub_query"))).alias("held"), F.min("sub_no").alias("first"))
    rows = kept.join(held, "query_id").join(questions.select("query_id", "text"), "query_id")
    lost = F.array_except(_terms(F.col("text")), "held")
    text = F.when((F.col("sub_no") == F.col("first")) & (F.size(lost) > 0), F.concat("sub_query", F.lit(" "), F.array_join(lost, " "))).otherwise(F.col("sub_query"))
    return rows.select("query_id", "sub_no", text.alias("sub_query"), "depends_on")


def dag_valid(subs: DataFrame) -> DataFrame:
    """Q8: (query_id, valid): every dependency is another part of the question."""
    edges = subs.select("query_id", "sub_no", F.explode("depends_on").alias("on"))
    nodes = subs.select("query_id", F.col("sub_no").alias("on")).distinct()
    bad = edges.join(nodes, ["query_id", "on"], "left_anti").select("query_id").unionByName(edges.filter("on = sub_no").select("query_id")).distinct()
    return subs.select("query_id").distinct().join(bad.withColumn("bad", F.lit(True)), "query_id", "left").select("query_id", F.col("bad").isNull().alias("valid"))


def expand_query(text: Column, dictionary: Mapping[str, Sequence[str]], polite: str = r"(?iu)^(?:xin hỏi|cho hỏi|cho tôi biết)[,\s]*", most_terms: int = 6) -> Column:
    """The question without its polite beginning, then up to ``most_terms`` dictionary terms whose key occurs in it, each once, in order."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), polite, "")
    hits = F.flatten(F.array(*[F.when(F.lower(bare).contains(k.lower()), F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for k, ts in dictionary.items()]))
    fresh = F.filter(F.array_distinct(hits), lambda t: ~F.lower(bare).contains(F.lower(t)))
    return F.concat_ws(" ", F.trim(bare), F.nullif(F.array_join(F.slice(fresh, 1, most_terms), " "), F.lit("")))


# Words of a question that are not searched for, the context of all questions, and the word that shows it is there.
IDLE_WORDS = ("tôi", "cho", "hỏi", "được", "không", "thì", "có")
CONTEXT, CONTEXT_WORD = "Bộ luật Lao động", "lao động"


def expand_questions(
    questions: DataFrame, dictionary: DataFrame, documents: Rules | None = None, prefixes: Sequence[str] = (r"^(?:xin hỏi|cho hỏi|cho tôi biết)[,\s]*",), most_terms: int = 6, most_tokens: int = 5, most_words: int = 4,
    idle: Sequence[str] = IDLE_WORDS, context: str = CONTEXT, context_word: str = CONTEXT_WORD,
) -> DataFrame:
    """R15 with a dictionary table: (query_id, search, rewritten, terms, articles, documents) of ``questions`` (query_id, text).

    ``dictionary``: (entry, key, terms), keys of up to ``most_words`` words; runs of the question's words are joined to the keys by equality, so its size is not in the plan. Terms come in order of entry.
    ``search`` is, each once whatever its case: the articles that are named, the documents (label -> patterns), the first ``most_terms`` terms, the first ``most_tokens`` words of two letters or more that are not ``idle`` of the question without its polite ``prefixes``, and
    ``context`` unless a part holds ``context_word``. ``rewritten`` is that question with its first three terms. A blank question is its own search.
    """
    ws = lower_words(F.col("text"))
    none = F.array().cast("array<string>")

    def runs_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))
        return F.when(F.size(ws) >= n, F.transform(places, lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(none)

    runs = F.flatten(F.array(*map(runs_of, range(1, most_words + 1))))
    keys = dictionary.select("entry", F.array_join(lower_words(F.col("key")), " ").alias("_key"), "terms").filter("_key <> ''")
    hits = questions.select("query_id", F.explode(F.array_distinct(runs)).alias("_key")).join(keys, "_key")
    held = hits.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("entry", "terms"))), lambda x: x["terms"])).alias("terms"))
    rows = questions.select("query_id", "text").join(held, "query_id", "left").withColumn("terms", F.coalesce("terms", none))
    bare = F.trim(F.coalesce("text", F.lit("")))
    for p in prefixes:
        bare = F.trim(F.regexp_replace(bare, f"(?iu){p}", ""))
    low = F.lower(F.coalesce("text", F.lit("")))
    articles = F.transform(extract_references(F.col("text")), lambda a: F.concat(F.lit("Điều "), a))
    rows = rows.withColumns({"_bare": bare, "articles": articles, "documents": tag_rules(low, documents or {}).cast("array<string>")})
    tokens = F.filter(F.regexp_extract_all("_bare", F.lit(r"[\p{L}\p{N}_]+"), 0), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*idle))
    parts = F.concat("articles", "documents", F.slice("terms", 1, most_terms), F.slice(tokens, 1, most_tokens))
    parts = once(parts, lambda ps: F.concat(ps, F.when(F.exists(ps, lambda p: F.lower(p).contains(context_word)), none).otherwise(F.array(F.lit(context)))))
    seen = once(F.transform(parts, lambda p: F.struct(F.trim(p).alias("p"), F.lower(F.trim(p)).alias("l"))), lambda ps: F.transform(F.filter(ps, lambda x, i: (x["l"] != "") & (F.array_position(F.transform(ps, lambda y: y["l"]), x["l"]) == i + 1)), lambda x: x["p"]))
    rewritten = F.when(F.size("terms") > 0, F.concat("_bare", F.lit(" ("), F.array_join(F.slice("terms", 1, 3), ", "), F.lit(")"))).otherwise(F.col("_bare"))
    return rows.select("query_id", F.when(F.trim(low) == "", F.col("text")).otherwise(F.array_join(seen, " ")).alias("search"), F.when(F.trim(low) == "", F.col("text")).otherwise(rewritten).alias("rewritten"), "terms", "articles", "documents")


def flag_ambiguous(text: Column, topics: Sequence[str], resolving: Sequence[str]) -> Column:
    """A topic word is there, and no word that says which."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda ws: F.greatest(F.lit(False), F.lit(False), *[low.contains(w) for w in ws])
    return has(topics) & ~has(resolving)


def rewrite_query(text: Column, prefix: str, suffix: str, replacements: Mapping[str, str], subject: str = "") -> Column:
    """Without prefix and suffix patterns, words replaced, and the subject put first where it is not named; never adds a citation."""
    from docketry.functions.text import expand_abbreviations

    out = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), prefix, ""), suffix, ""))
    out = expand_abbreviations(out, replacements)
    return F.when(F.lit(bool(subject)) & ~F.lower(out).contains(subject.lower()), F.concat(F.lit(subject + " "), out)).otherwise(out)
