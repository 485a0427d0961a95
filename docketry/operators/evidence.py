"""Evidence from texts and tables to a verdict: coverage and conditions (G3), content scores under periods of validity (G4, G5), and a second search where the first failed.

Candidates are rows (query_id, doc_id, score, rank, query, content); a query without candidates is kept by its row in the table of questions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import once, one_of, strip
from docketry.operators.guards import matches_any, tag_rules
from docketry.sources.scratch import written

# Words of a question that tell no evidence apart, and those that say that it has several parts.
EVIDENCE_STOP_WORDS = (
    "của cho các những được trong theo nào gì như thế khi quy định lao động người sử dụng nhiêu phải khoản điều về có hay với tại ở này đó ra sao bao một hai ba bốn năm thực hiện áp văn bản pháp luật "
    "trường hợp vấn đề biết hỏi thưa xin ạ nhỉ nhé giúp tôi em mình"
).split()
SEVERAL = ("và", "đồng thời", "vừa", "kết hợp")
# Numbers and words that say under which conditions a rule holds.
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:\s*(?:%|ngày|tháng|năm|giờ|triệu|đồng))?(?![\p{L}\p{N}_])"
CONDITION = r"(?<![\p{L}\p{N}_])(?:trường\s+hợp|điều\s+kiện|quy\s+định|nếu|trừ\s+khi|ngoại\s+lệ)(?![\p{L}\p{N}_])"
#: Added before rounding, so that sums in any order round ties alike.
TIE = 1e-9


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[text.contains(w) for w in words])


def grade_evidence(
    questions: DataFrame, candidates: DataFrame, conditions: Mapping[str, Sequence[Sequence[str]]] | None = None, strict: Sequence[str] = (), out_of_scope: Sequence[str] = (), external: Sequence[str] = (),
    several: Sequence[str] = SEVERAL, stop_words: Sequence[str] = EVIDENCE_STOP_WORDS, similar: float = 0.45, sufficient: float = 0.70,
) -> tuple[DataFrame, DataFrame]:
    """G3 from texts: (candidates with ``n_matched``, ``coverage``, ``relevant`` and ``evidence``, verdicts (query_id, n_relevant, evidence, status, confidence) of ``questions`` (query_id, text)).

    Coverage is the share of a question's significant words that its candidate holds. ``conditions`` are extracted from the question: a condition (the words to be found) is asked for if all the
    words of one of its sets occur. A candidate without a ``strict`` condition that is asked for is worth nothing; else it is relevant with a score of ``similar`` and two words of the question (or its only one)
    if it holds one of the conditions, or, where none is asked for, with a coverage of 0.3 or three words.

    A blank question, one without candidates, one with an ``out_of_scope`` word and one that names an ``external`` document which no candidate is a part of (its id) or quotes with a percentage are
    INSUFFICIENT. So is one without relevant candidates. SUFFICIENT are two relevant ones of ``sufficient`` evidence on average, or one of 0.65 if the question has no word of ``several``; else PARTIAL.
    """
    ask = F.lower(strip(F.coalesce("query", F.lit(""))))
    significant = F.filter(F.regexp_extract_all(ask, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: (F.length(w) >= 2) & ~one_of(w, stop_words))
    asked_for = F.array_compact(F.array(*[F.when(F.greatest(F.lit(False), F.lit(False), *[F.least(F.lit(True), F.lit(True), *[ask.contains(w) for w in ws]) for ws in sets]), F.lit(c)) for c, sets in (conditions or {}).items()]).cast("array<string>"))
    text = F.concat_ws(" ", F.lower(F.coalesce("content", F.lit(""))), F.lower(F.col("doc_id").cast("string")))
    rows = candidates.withColumns({"_words": significant, "_asked": asked_for})
    held = once(text, lambda t: F.struct(F.size(F.filter("_words", lambda w: t.contains(w))).alias("n"), F.filter("_asked", lambda c: t.contains(c)).alias("conditions")))
    rows = rows.withColumn("_held", held)
    n, size = F.col("_held.n"), F.size("_words")
    ratio = n / F.greatest(size, F.lit(1))
    void = F.size(F.array_intersect(F.array_except("_asked", "_held.conditions"), F.array(*map(F.lit, strict)).cast("array<string>"))) > 0
    enough = (F.col("score") >= similar) & ((n >= 2) | ((size == 1) & (n == 1)))
    fits = F.when(F.size("_asked") > 0, F.size("_held.conditions") > 0).otherwise((ratio >= 0.3) | (n >= 3))
    outside = _any(ask, out_of_scope)
    low = F.lower(F.coalesce("content", F.lit("")))
    quoted = [F.when(ask.contains(e), F.lower(F.col("doc_id").cast("string")).contains(e) | ((ask.contains("phần trăm") | ask.contains("%")) & (low.contains("%") | low.contains("phần trăm")) & low.contains(e))) for e in external]
    if quoted:  # every external document that is asked for must be held by some candidate
        of = W.partitionBy("query_id")
        outside = outside | F.greatest(F.lit(False), F.lit(False), *[F.coalesce(~F.bool_or(q).over(of), F.lit(False)) for q in quoted])
    rows = rows.withColumns({"_outside": outside | (ask == ""), "_fits": F.coalesce(enough & fits & ~void, F.lit(False))})
    relevant = F.col("_fits") & ~F.col("_outside")
    value = F.when(F.col("_outside") | void, 0.0).when(relevant, F.round(F.least(F.lit(1.0), 0.5 + ratio * 0.5), 4)).otherwise(F.round(ratio * 0.3, 4))
    graded = rows.withColumns({"n_matched": n, "coverage": F.round(ratio, 4), "relevant": relevant, "evidence": value})
    per = graded.groupBy("query_id").agg(F.count_if("relevant").alias("n_relevant"), F.avg(F.when(F.col("relevant"), F.col("evidence"))).alias("mean"), F.bool_or("_outside").alias("_outside"))
    out = questions.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("_q")).dropDuplicates(["query_id"]).join(per, "query_id", "left")
    mean, many = F.col("mean"), _any(F.col("_q"), several)
    full = ((F.col("n_relevant") >= 2) & (mean >= sufficient)) | ((F.col("n_relevant") == 1) & ~many & (mean >= 0.65))
    status = F.when(F.coalesce("n_relevant", F.lit(0)) == 0, "INSUFFICIENT").when(full, "SUFFICIENT").otherwise("PARTIAL")
    sure = F.least(F.lit(1.0), F.when(F.col("n_relevant") >= 2, 0.75).otherwise(0.70) + mean * 0.25)
    confidence = F.when(F.col("n_relevant").isNull() | (strip(F.col("_q")) == ""), 1.0).when(F.col("_outside"), 0.95).when(F.col("n_relevant") == 0, 0.85).when(full, sure).otherwise(F.least(F.lit(0.65), 0.35 + mean * 0.30))
    verdict = out.select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.round(F.coalesce("mean", F.lit(0.0)) + TIE, 4).alias("evidence"), status.alias("status"), F.round(confidence + TIE, 4).alias("confidence"))
    return graded.drop(*[c for c in graded.columns if c.startswith("_")]), verdict


def in_force(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``in_force`` to candidates (query_id, doc_id, as_of, ...) by an interval join with ``registry`` (doc_id, effective_from, effective_to, legal_status), one row for each period of a document.

    The period that holds the date counts (the latest, if several do; both ends are in it and a null end is open): 0 if its status is repealed or expired, 0.8 if it is not in force yet, else 1. With periods but
    none on the date it is 0.8 before the first and 0 else; 1 for a document that is not registered and for a null date, which any period holds.
    """
    keys = candidates.select("query_id", "doc_id", "as_of").distinct()
    periods = registry.select("doc_id", "effective_from", "effective_to", "legal_status")
    day, start, end = F.col("as_of"), F.col("effective_from"), F.col("effective_to")
    on = F.coalesce((start <= day) | start.isNull() | day.isNull(), F.lit(False)) & F.coalesce((end >= day) | end.isNull() | day.isNull(), F.lit(False))
    per = keys.join(periods, "doc_id").groupBy("query_id", "doc_id", "as_of").agg(
        F.max(F.when(on, F.struct(F.coalesce(start, F.lit("0001-01-01").cast("date")).alias("s"), F.coalesce("legal_status", F.lit("ACTIVE")).alias("status")))).alias("now"), F.bool_and(F.coalesce(start > day, F.lit(False))).alias("ahead"),
    )
    value = F.when(F.col("now.status").isin("REPEALED", "EXPIRED"), 0.0).when(F.col("now.status") == "FUTURE_ACTIVE", 0.8).when(F.col("now").isNotNull(), 1.0).when(F.col("ahead"), 0.8).otherwise(0.0)
    same = (candidates["query_id"] == F.col("_q")) & (candidates["doc_id"] == F.col("_d")) & candidates["as_of"].eqNullSafe(F.col("_a"))
    out = candidates.join(per.select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d"), F.col("as_of").alias("_a"), value.alias("in_force")), same, "left")
    return out.drop("_q", "_d", "_a").withColumn("in_force", F.coalesce("in_force", F.lit(1.0)))


def score_evidence(
    candidates: DataFrame, registry: DataFrame, issues: Mapping[str, Sequence[str]], subjects: Mapping[str, Sequence[str]], anyone: str | None = None, colloquial: Sequence[str] = (), number: str = NUMBER,
    condition: str = CONDITION, weights: Sequence[float] = (0.25, 0.25, 0.30, 0.20),
) -> DataFrame:
    """Add sem, subject, issue, condition, in_force, mismatch and chunk_score to candidates with ``as_of``, from texts, rule tables (label -> patterns) and the registry.

    Subject and issue are 1 if the content has a label of the question's, or the question has none (for subjects also if it has ``anyone``); condition is 1 with a number and a word of
    condition, 0.6 with either, else 0.2. A chunk mismatches if the question has issues, the content none of them, and the question does not sound ``colloquial``.
    """
    ask, low = F.lower(F.coalesce("query", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    rows = in_force(candidates, registry).withColumns({"_i": tag_rules(ask, issues), "_s": tag_rules(ask, subjects), "_ci": tag_rules(low, issues), "_cs": tag_rules(low, subjects)})
    shared = lambda a, b: F.size(F.array_intersect(a, b)) > 0
    general = (F.size("_s") == 0) | (F.array_contains("_s", anyone) if anyone else F.lit(False))
    subject = F.when(general | shared("_s", "_cs"), 1.0).otherwise(0.0)
    issue = F.when((F.size("_i") == 0) | shared("_i", "_ci"), 1.0).otherwise(0.0)
    found = low.rlike(number).cast("int") + low.rlike(condition).cast("int")
    cond = F.when(found == 2, 1.0).when(found == 1, 0.6).otherwise(0.2)
    sem = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.5))))
    rows = rows.withColumns({"sem": sem, "subject": subject, "issue": issue, "condition": cond, "mismatch": (F.size("_i") > 0) & ~shared("_i", "_ci") & ~matches_any(ask, colloquial)})
    total = F.col("in_force") * sum((F.lit(w) * F.col(c) for w, c in zip(weights, ("sem", "subject", "issue", "condition"), strict=True)), F.lit(0.0))
    return rows.withColumn("chunk_score", F.round(total, 4)).drop("_i", "_s", "_ci", "_cs")


def evidence_report(questions: DataFrame, scored: DataFrame, bonus: float = 0.15, least: float = 0.50, semantic: float = 0.78) -> DataFrame:
    """(query_id, n, best, bonus, composite, refused, reason) of :func:`score_evidence` rows.

    The best chunk (ties: by rank) gets ``bonus`` if its condition is under 0.8 and another chunk of 0.40 or more has one of 0.8. Vetoed, with 0, where all chunks mismatch and none has a ``sem`` of ``semantic``;
    refused below ``least`` and without chunks.
    """
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("chunk_score"), "rank", "doc_id"))
    rows = scored.withColumn("_turn", turn)
    best = lambda c: F.max(F.when(F.col("_turn") == 1, F.col(c)))
    other = F.bool_or((F.col("_turn") > 1) & (F.col("chunk_score") >= 0.40) & (F.col("condition") >= 0.8))
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), best("chunk_score").alias("best"), best("condition").alias("_c"), other.alias("_other"), F.bool_and("mismatch").alias("_off"), F.max("sem").alias("_sem"))
    out = questions.select("query_id").distinct().join(per, "query_id", "left")
    veto = F.coalesce(F.col("_off") & (F.col("_sem") < semantic), F.lit(False))
    extra = F.when(~veto & F.col("_other") & (F.col("_c") < 0.8), bonus).otherwise(0.0)
    composite = F.when(veto, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)) + extra), 4))
    reason = F.when(F.col("n").isNull(), "no_candidates").when(veto, "issue_mismatch").when(composite < least, "low_evidence")
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0.0)).alias("best"), extra.alias("bonus"), composite.alias("composite"), reason.isNotNull().alias("refused"), reason.alias("reason"))


def corrective_retrieve(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], contents: DataFrame, rewrite: Callable[[Column], Column], **rules
) -> tuple[DataFrame, DataFrame]:
    """(kept chunks (query_id, doc_id, score, rank), records (query_id, first, second, retries, rewritten, n_kept, refused)) of ``questions`` (query_id, text).

    ``search`` gives (query_id, doc_id, score, rank) for a table of questions, such as ``bm25_topk`` over a stored index. Its results are graded (:func:`grade_evidence`, ``rules``) with the texts of
    ``contents`` (doc_id, content); only questions that are not SUFFICIENT are rewritten, searched and graded again. Kept are the relevant chunks of the second pass where that is SUFFICIENT, chunks that either pass finds relevant where it is
    PARTIAL (those of the second pass first), else those of the first where that was PARTIAL, else none. A question is refused without chunks, and if both passes are INSUFFICIENT. The texts of the few chunks found are read once a pass.
    """
    questions = questions.select("query_id", "text")

    def graded(asked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        found = search(asked).join(contents.select("doc_id", "content"), "doc_id").join(asked.withColumnRenamed("text", "query"), "query_id")
        rows, verdict = grade_evidence(asked, written(found, f"{name}-found"), **rules)
        return written(rows.select("query_id", "doc_id", "score", "rank", "relevant"), f"{name}-graded"), written(verdict, f"{name}-verdict")

    first, verdict = graded(questions, "corrective-first")
    again = questions.join(verdict.filter("status <> 'SUFFICIENT'").select("query_id"), "query_id").withColumn("text", rewrite(F.col("text")))
    again = written(again, "corrective-again")
    second, second_verdict = graded(again, "corrective-second")
    records = verdict.select("query_id", F.col("status").alias("first")).join(second_verdict.select("query_id", F.col("status").alias("second")), "query_id", "left")
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2))).join(records, "query_id")
    liked = F.bool_or("relevant").over(W.partitionBy("query_id", "doc_id"))
    keep = (
        F.when(F.col("second").isNull(), F.col("relevant")).when(F.col("second") == "SUFFICIENT", (F.col("pass") == 2) & F.col("relevant")).when(F.col("second") == "PARTIAL", F.col("_liked"))
        .otherwise((F.col("pass") == 1) & F.col("relevant") & (F.col("first") == "PARTIAL"))
    )
    order = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("pass")))
    kept = both.withColumn("_liked", liked).filter(keep).withColumn("_turn", order).filter("_turn = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("pass"), "rank", "doc_id"))
    kept = written(kept.select("query_id", "doc_id", "score", place.alias("rank")), "corrective-kept")
    sizes = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"))
    out = records.join(again.select("query_id", F.col("text").alias("rewritten")), "query_id", "left").join(sizes, "query_id", "left")
    n = F.coalesce("n_kept", F.lit(0))
    refused = (n == 0) | ((F.col("first") == "INSUFFICIENT") & F.coalesce(F.col("second") == "INSUFFICIENT", F.lit(False)))
    return kept, out.select("query_id", "first", "second", F.col("second").isNotNull().cast("int").alias("retries"), "rewritten", n.alias("n_kept"), refused.alias("refused"))
