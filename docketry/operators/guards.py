"""Grading of evidence and guards, as rules over tables of questions, candidates and answers. Rule sets are data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import INDEX_STOP_WORDS, WHITE, extract_references, lower_words, once, one_of, strip, words

UPPER, LOWER = 0.68, 0.45


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), *[F.coalesce(text.rlike(p), F.lit(False)) for p in patterns]) if patterns else F.lit(False)


def tag_rules(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Array of the labels of which a pattern occurs, in the order of ``rules``. Patterns are compiled once a task."""
    return F.array_compact(F.array(*[F.when(matches_any(text, ps), F.lit(label)) for label, ps in rules.items()]))


def grade_chunks(rows: DataFrame, out_of_scope: Sequence[str] = (), stop_words: Sequence[str] = INDEX_STOP_WORDS, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """G1: add ``grade_score`` and ``grade`` (CORRECT, AMBIGUOUS, INCORRECT) to rows (query_id, doc_id, score, query, title, article, content), by the first rule that fits.

    Words outside the scope 0.35 x score; a named article at least 0.85; half of the word pairs in the title, or half in the content with 60 % of the single words: 0.35
    score + 0.4 content pairs + 0.25 title pairs, at least 0.7; a quarter of the pairs (or half of the single words where there are no pairs): half and half; nothing
    0.4 x score; else 0.4 score + 0.3 single words.
    """
    title, content = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    every = lower_words(F.col("query"))
    fine = lambda w: ~one_of(w, stop_words)
    singles = F.array_distinct(F.filter(every, lambda w: (F.length(w) >= 2) & fine(w)))
    nexts = F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))
    pairs = F.array_distinct(F.filter(F.zip_with(every, nexts, lambda a, b: F.when(fine(a) & fine(b), F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull()))
    share = lambda terms, text: F.when(F.size(terms) > 0, once(text, lambda x: F.size(F.filter(terms, lambda t: x.contains(t)))) / F.size(terms)).otherwise(0.0)
    pt, pc, sc = share(pairs, title), share(pairs, content), share(singles, content)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    asked = extract_references(F.col("query"))
    named = F.size(F.array_intersect(asked, extract_references(F.concat_ws(" ", F.coalesce("article", F.lit("")), title, content)))) > 0
    outside = F.greatest(F.lit(False), *[F.lower("query").contains(w) for w in out_of_scope]) if out_of_scope else F.lit(False)
    strong = (pt >= 0.5) | ((pc >= 0.5) & (sc >= 0.6))
    part = (pc >= 0.25) | ((F.size(pairs) == 0) & (sc >= 0.5))
    nothing = (pt + pc + sc) == 0
    rule = F.when(outside, "outside").when(named, "named").when(strong, "strong").when(part, "part").when(nothing, "nothing").otherwise("weak")
    value = (
        F.when(F.col("_rule") == "outside", raw * 0.35).when(F.col("_rule") == "named", F.greatest(raw, F.lit(0.85)))
        .when(F.col("_rule") == "strong", F.least(F.lit(1.0), F.greatest(F.lit(0.70), 0.35 * raw + 0.40 * pc + 0.25 * pt)))
        .when(F.col("_rule") == "part", 0.5 * raw + 0.5 * pc).when(F.col("_rule") == "nothing", raw * 0.4).otherwise(0.4 * raw + 0.6 * (sc * 0.5))
    )
    scored = rows.withColumn("_rule", rule).withColumn("grade_score", F.round(value, 4))
    by_score = F.when((F.col("_rule") == "part") & (F.col("grade_score") >= upper), "CORRECT").when(F.col("_rule").isin("part", "weak") & (F.col("grade_score") >= lower), "AMBIGUOUS").otherwise("INCORRECT")
    return scored.withColumn("grade", F.when(F.col("_rule").isin("named", "strong"), "CORRECT").otherwise(by_score)).drop("_rule")


def grade_query(questions: DataFrame, graded: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """(query_id, n_correct, n_ambiguous, confidence, action): REFINE with a correct chunk of ``upper`` or more, COMBINE_SEARCH with any correct or ambiguous one, WEB_SEARCH
    with a score of ``lower`` or more, else REFUSE; a query without chunks is refused.
    """
    per = graded.groupBy("query_id").agg(F.count_if(F.col("grade") == "CORRECT").alias("n_correct"), F.count_if(F.col("grade") == "AMBIGUOUS").alias("n_ambiguous"), F.max("grade_score").alias("confidence"))
    rows = questions.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n_correct", "n_ambiguous", "confidence"])
    action = F.when((F.col("n_correct") > 0) & (F.col("confidence") >= upper), "REFINE").when(F.col("n_correct") + F.col("n_ambiguous") > 0, "COMBINE_SEARCH").when(F.col("confidence") >= lower, "WEB_SEARCH").otherwise("REFUSE")
    return rows.withColumn("action", action)


def evidence_gate(questions: DataFrame, scored: DataFrame, bonus: float = 0.15, least: float = 0.50, semantic: float = 0.78) -> DataFrame:
    """(query_id, best, gate_score, passed, reason) of candidates (query_id, sem, subject, issue, condition, in_force 0/0.8/1, mismatch).

    A candidate scores in_force x (0.25 sem + 0.25 subject + 0.30 issue + 0.20 condition); the best gets ``bonus`` x the share of candidates of 0.55 or more. No candidates, all
    issues mismatched without a ``sem`` of ``semantic``, or less than ``least`` refuse.
    """
    value = F.col("in_force") * (0.25 * F.col("sem") + 0.25 * F.col("subject") + 0.30 * F.col("issue") + 0.20 * F.col("condition"))
    rows = scored.withColumn("_s", value)
    per = rows.groupBy("query_id").agg(F.max("_s").alias("best"), F.avg((F.col("_s") >= 0.55).cast("double")).alias("covered"), F.bool_and("mismatch").alias("off"), F.max("sem").alias("top"))
    out = questions.select("query_id").distinct().join(per, "query_id", "left")
    total = F.round(F.least(F.lit(1.0), F.coalesce(F.col("best") + bonus * F.col("covered"), F.lit(0.0))), 4)
    reason = F.when(F.col("best").isNull(), "no_candidates").when(F.col("off") & (F.col("top") < semantic), "issue_mismatch").when(total < least, "low_evidence")
    return out.select("query_id", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best"), total.alias("gate_score"), reason.isNull().alias("passed"), reason.alias("reason"))


def evidence_status(questions: DataFrame, rows: DataFrame, full: float = 0.5, part: float = 0.25) -> DataFrame:
    """(query_id, n_full, n_partial, status, confidence) of chunks (query_id, doc_id, coverage, conditions_met).

    A chunk with ``full`` keyword coverage and its conditions met is enough: SUFFICIENT; with one of ``part`` coverage PARTIAL; else INSUFFICIENT. Confidence is the best coverage.
    """
    per = rows.groupBy("query_id").agg(
        F.count_if((F.col("coverage") >= full) & F.col("conditions_met")).alias("n_full"), F.count_if(F.col("coverage") >= part).alias("n_partial"), F.round(F.max("coverage"), 4).alias("confidence"),
    )
    out = questions.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n_full", "n_partial", "confidence"])
    status = F.when(F.col("n_full") > 0, "SUFFICIENT").when(F.col("n_partial") > 0, "PARTIAL").otherwise("INSUFFICIENT")
    return out.select("query_id", "n_full", "n_partial", status.alias("status"), "confidence")


def scope_check(text: Column, greetings: Sequence[str], foreign: Mapping[str, Sequence[str]], actors: Sequence[str], actions: Sequence[str]) -> Column:
    """``greeting`` (a greeting word, three words at most), ``ambiguous`` (two words at most), the label of a foreign domain unless an actor and an action word are there; else null."""
    low, n = F.lower(F.coalesce(text, F.lit(""))), F.size(words(text))
    has = lambda ws: F.greatest(F.lit(False), F.lit(False), *[low.contains(w) for w in ws])
    ours = has(actors) & has(actions)
    domains = [F.when(has(ws) & ~ours, F.lit(label)) for label, ws in foreign.items()]
    return F.coalesce(F.when(has(greetings) & (n <= 3), "greeting"), F.when(n <= 2, "ambiguous"), *domains)


def resolve_named_documents(questions: DataFrame, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(query_id, document, refused) for the first of ``rules`` (pattern, document, supported) that the text has; unsupported ones come first. No row for others."""
    ordered = sorted(enumerate(rules), key=lambda r: (r[1][2], r[0]))
    hit = F.coalesce(*[F.when(F.col("text").rlike(p), F.struct(F.lit(doc).alias("document"), F.lit(not ok).alias("refused"))) for _, (p, doc, ok) in ordered])
    return questions.select("query_id", hit.alias("hit")).filter("hit IS NOT NULL").select("query_id", "hit.*")


def pre_guard(questions: DataFrame, retrieved: DataFrame, least: float = 0.45) -> DataFrame:
    """(query_id, n, top, refuse): refused without chunks or with a best score below ``least``."""
    per = retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    rows = questions.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n"])
    return rows.withColumn("refuse", F.coalesce(F.col("top") < least, F.lit(True)))


def post_guard(resolved: DataFrame) -> DataFrame:
    """Add ``refuse``: there were tags and none could be resolved (arrays ``resolved`` and ``invalid``)."""
    return resolved.withColumn("refuse", (F.size("resolved") == 0) & (F.size("invalid") > 0))


# Beginnings of sentences that claim nothing.
NO_CLAIM = (r"^xin chào", r"^cảm ơn bạn", r"^tôi có thể giúp", r"^dưới đây là", r"^sau đây là", r"^chúc bạn", r"^kết luận:")


def claims_of(answer: Column, least: int = 15, ignored: Sequence[str] = NO_CLAIM) -> Column:
    """Sentences of ``least`` characters or more that do not end in a colon nor begin as an ``ignored`` pattern."""
    pieces = F.transform(F.split(F.coalesce(answer, F.lit("")), rf"(?<=[.!?\n]){WHITE}+"), strip)
    return F.filter(pieces, lambda s: (F.length(s) >= least) & ~s.endswith(":") & ~matches_any(F.lower(s), ignored))


def claim_status(claim: Column, context: Column, overlap: float = 0.40) -> Column:
    """CONTRADICTED if the claim names an article that the (lower-case) context does not, ENTAILED if ``overlap`` of its words of three characters or more and all its numbers occur, else UNSUPPORTED."""
    low = F.lower(claim)
    articles = lambda t: F.regexp_extract_all(t, F.lit(r"điều\s+(\d+[a-zA-Z]*)"), 1)
    long = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: F.length(w) >= 3)
    numbers = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])\d+(?:[\d.,]*\d)?(?![\p{L}\p{N}_])"), 0)
    share = F.size(F.filter(long, lambda w: context.contains(w))) / F.size(long)
    entailed = (F.size(long) == 0) | ((share >= overlap) & F.forall(numbers, lambda n: context.contains(n)))
    return F.when(F.size(F.array_except(articles(low), articles(context))) > 0, "CONTRADICTED").when(entailed, "ENTAILED").otherwise("UNSUPPORTED")


def verify_claims(answers: DataFrame, threshold: float = 0.65, block: float = 0.40, overlap: float = 0.40) -> DataFrame:
    """(answer_id, n_claims, n_entailed, n_contradicted, score, action) of answers (answer_id, answer, context).

    Blank answers and contexts are blocked; answers without claims are allowed; a contradiction or a score below ``block`` blocks, one below ``threshold`` gets a disclaimer.
    """
    low = F.lower(F.coalesce("context", F.lit("")))
    status = once(low, lambda x: F.transform(claims_of(F.col("answer")), lambda c: claim_status(c, x, overlap)))
    of = lambda s: F.size(F.filter("status", lambda x: x == s))
    rows = answers.select("answer_id", "answer", "context", status.alias("status"))
    n, entailed, wrong = F.size("status"), of("ENTAILED"), of("CONTRADICTED")
    blank = (strip(F.coalesce("answer", F.lit(""))) == "") | (strip(F.coalesce("context", F.lit(""))) == "")
    score = F.when(blank, 0.0).when(n == 0, 1.0).otherwise(F.round(entailed / n, 4))
    action = F.when(blank, "BLOCK_REFUSAL").when(n == 0, "ALLOW").when((wrong > 0) | (score < block), "BLOCK_REFUSAL").when(score < threshold, "ADD_DISCLAIMER").otherwise("ALLOW")
    return rows.select("answer_id", n.alias("n_claims"), entailed.alias("n_entailed"), wrong.alias("n_contradicted"), score.alias("score"), action.alias("action"))


def align_answer(answers: DataFrame, overlap: float = 0.35, formula: str = r"\d+\s*[x×*/]\s*\d+") -> DataFrame:
    """(answer_id, answer, refused): only claims with ``overlap`` of their words in the context, or a formula, stay; none left, and the answer is refused."""
    low = F.lower(F.coalesce("context", F.lit("")))
    long = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: F.length(w) >= 3)
    share = lambda c, x: F.size(F.filter(long(c), lambda w: x.contains(w))) / F.greatest(F.size(long(c)), F.lit(1))
    kept = once(low, lambda x: F.filter(claims_of(F.col("answer")), lambda c: (share(c, x) >= overlap) | c.rlike(formula)))
    return answers.select("answer_id", F.array_join(kept, " ").alias("answer"), (F.size(kept) == 0).alias("refused"))


def retrieval_confidence(questions: DataFrame, retrieved: DataFrame, high: float = 0.70, low: float = 0.45) -> DataFrame:
    """(query_id, level, escalate): HIGH, AMBIGUOUS, LOW or EMPTY by the best score, and the route to escalate to."""
    rows = pre_guard(questions, retrieved, low)
    level = F.when(F.col("n") == 0, "EMPTY").when(F.col("top") >= high, "HIGH").when(F.col("top") >= low, "AMBIGUOUS").otherwise("LOW")
    return rows.select("query_id", level.alias("level"), F.when(level == "AMBIGUOUS", "corrective").when(level.isin("LOW", "EMPTY"), "decompose").alias("escalate"))


def apply_gates(questions: DataFrame, gates: Sequence[DataFrame]) -> DataFrame:
    """(query_id, refused_by, reason) by the first of ``gates``, each (query_id, reason), that has a reason; null if none has."""
    rows = questions.select("query_id").distinct()
    for k, gate in enumerate(gates):
        rows = rows.join(gate.select("query_id", F.col("reason").alias(f"_r{k}")), "query_id", "left")
    tier = F.coalesce(*[F.when(F.col(f"_r{k}").isNotNull(), F.lit(k + 1)) for k in range(len(gates))])
    return rows.select("query_id", tier.alias("refused_by"), F.coalesce(*[f"_r{k}" for k in range(len(gates))]).alias("reason"))
