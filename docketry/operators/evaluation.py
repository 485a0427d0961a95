"""Evaluation of retrieval, answers, citations, refusals, routing, latency and cost over tables of records.

Retrieved rows are (query_id, doc_id, rank, score); gold rows are (query_id, doc_id); a question without gold rows keeps a row with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import ANSWER_STOP_WORDS, token_f1
from docketry.operators.quantiles import profile

CUTS = (1, 3, 5, 10)


def retrieval_metrics(questions: DataFrame, retrieved: DataFrame, gold: DataFrame, cuts: Sequence[int] = CUTS, sizes: DataFrame | None = None) -> DataFrame:
    """M1, M2: per question hit, recall and precision at each cut (precision over the cut) and the reciprocal rank of the first hit (0 without one).

    Where gold is too large to list, ``sizes`` has (query_id, n_gold), and ``gold`` only what of it was retrieved.
    """
    marked = retrieved.join(gold.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    found = lambda k: F.countDistinct(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("doc_id")))
    per = marked.groupBy("query_id").agg(*[found(k).alias(f"found_{k}") for k in cuts], F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    size = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_gold")) if sizes is None else sizes.select("query_id", "n_gold")
    rows = questions.select("query_id").distinct().join(per, "query_id", "left").join(size, "query_id", "left")
    n = F.coalesce("n_gold", F.lit(0))
    out = ["query_id", n.alias("n_gold"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in cuts:
        got = F.coalesce(f"found_{k}", F.lit(0))
        out += [(got > 0).cast("int").alias(f"hit_{k}"), F.when(n > 0, got / n).otherwise(0.0).alias(f"recall_{k}"), (got / F.lit(k)).alias(f"precision_{k}")]
    return rows.select(*out)


def retrieval_error_flags(questions: DataFrame, retrieved: DataFrame, gold: DataFrame, low: float = 0.60, high: float = 0.70, alarm: float = 0.65, sizes: DataFrame | None = None) -> DataFrame:
    """M3: per question an array of flags. ``questions`` has query_id and requires_refusal; ``gold`` and ``sizes`` are as in M1."""
    marked = retrieved.join(gold.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    hit, rank, score = F.coalesce("hit", F.lit(False)), F.col("rank"), F.col("score")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = marked.groupBy("query_id").agg(
        any_(hit).alias("found"), any_(hit & (rank <= 5)).alias("hit5"), any_(~hit & (rank == 1)).alias("wrong1"),
        any_(hit & (score < low)).alias("low"), any_(~hit & (rank <= 3) & (score >= high)).alias("high"), F.max("score").alias("top"),
    )
    has_gold = (gold if sizes is None else sizes.filter("n_gold > 0")).select("query_id").distinct().withColumn("has_gold", F.lit(True))
    rows = questions.join(per, "query_id", "left").join(has_gold, "query_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    asked = ~F.col("requires_refusal") & yes("has_gold")
    flags = [
        F.when(asked & ~yes("found"), "missed_gold"), F.when(asked & ~yes("hit5"), "zero_hit_5"), F.when(asked & yes("wrong1"), "wrong_at_1"),
        F.when(asked & yes("low"), "low_score_correct"), F.when(asked & yes("high"), "high_score_irrelevant"),
        F.when(F.col("requires_refusal") & (F.col("top") >= alarm), "false_alarm"),
    ]
    return rows.select("query_id", F.array_compact(F.array(*flags)).alias("flags"))


def _flat(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def _covers(text: Column, article: Column, strict: bool) -> Column:
    """Whether space-free ``text`` names the article (or its number part). ``strict``: not followed by a further digit."""
    parts = F.split(_flat(article), "_")
    number = F.element_at(parts, -1)
    if not strict:
        return text.contains(_flat(article)) | text.contains(number)
    return F.regexp_like(text, F.concat(F.lit(r"\Q"), number, F.lit(r"\E(?!\d)")))


def answer_correctness(answer: Column, reference: Column, gold_articles: Column, citations: Column, refused: Column, requires_refusal: Column,
                       stop_words: Sequence[str] = ANSWER_STOP_WORDS, strict: bool = False) -> Column:
    """M5: struct (status, score, f1_score, article_recall). ``gold_articles``: array of "doc_article"."""
    gold = F.array_distinct(F.transform(F.coalesce(gold_articles, F.array().cast("array<string>")), _flat))
    texts = F.concat(F.array(_flat(F.coalesce(answer, F.lit("")))), F.transform(F.coalesce(citations, F.array().cast("array<string>")), _flat))
    matched = F.size(F.filter(gold, lambda g: F.exists(texts, lambda t: _covers(t, g, strict))))
    recall = F.when(F.size(gold) > 0, matched / F.size(gold)).otherwise(0.0)
    f1 = token_f1(answer, reference, stop_words)
    given = F.when((recall >= 1) & (f1 >= 0.20), "CORRECT").when((recall > 0) | (f1 >= 0.35), "PARTIALLY_CORRECT").otherwise("INCORRECT")
    status = F.when(requires_refusal, F.when(refused, "CORRECT").otherwise("INCORRECT")).when(refused, "INCORRECT").otherwise(given)
    plain = ~requires_refusal & ~refused
    settled = F.when(requires_refusal & refused, 1.0).otherwise(0.0)
    score = F.when(status == "CORRECT", 1.0).when(status == "PARTIALLY_CORRECT", 0.5).otherwise(0.0)
    return F.struct(status.alias("status"), score.alias("score"), F.when(plain, F.round(f1, 4)).otherwise(settled).alias("f1_score"), F.when(plain, F.round(recall, 4)).otherwise(settled).alias("article_recall"))


def citation_metrics(citations: Column, retrieved_articles: Column, gold_articles: Column, refused: Column, requires_refusal: Column) -> Column:
    """M6: struct (total, valid, gold_matching, coverage, precision, accuracy, invalid_rate). Articles are space-free lower-case names."""
    cited = F.transform(F.coalesce(citations, F.array().cast("array<string>")), _flat)
    names = lambda c, a: F.exists(a, lambda x: c.contains(x))
    total = F.size(cited)
    valid = F.filter(cited, lambda c: names(c, retrieved_articles))
    n_valid, n_gold = F.size(valid), F.size(F.filter(valid, lambda c: names(c, gold_articles)))
    safe = F.when(requires_refusal, 1.0).otherwise(0.0)
    ratio = lambda x: F.when(total > 0, F.round(x / total, 4)).otherwise(0.0)
    none = lambda x: F.when(refused, 0).otherwise(x)
    return F.struct(
        none(total).alias("total"), none(n_valid).alias("valid"), none(n_gold).alias("gold_matching"),
        F.when(refused, safe).otherwise((total > 0).cast("double")).alias("coverage"), F.when(refused, safe).otherwise(ratio(n_gold)).alias("precision"),
        F.when(refused, safe).otherwise(((total > 0) & (n_valid == total) & (n_gold > 0)).cast("double")).alias("accuracy"),
        F.when(refused, 0.0).otherwise(ratio(total - n_valid)).alias("invalid_rate"),
    )


def faithfulness(answer: Column, context: Column, refused: Column) -> Column:
    """M7: struct (status, score, support_ratio). ``context``: the retrieved texts as one; a word counts if it is a part of it."""
    whole = F.lower(F.coalesce(context, F.lit("")))
    articles = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"điều\s+(\d+)"), 1)
    unseen = F.size(F.array_except(articles(F.coalesce(answer, F.lit(""))), articles(whole))) > 0
    pieces = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"[.\n;]"), F.trim), lambda s: F.length(s) > 15)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.trim(F.coalesce(answer, F.lit("")))))
    long = lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: F.length(w) >= 3)
    supported = lambda s: (F.size(long(s)) > 0) & (F.size(F.filter(long(s), lambda w: whole.contains(w))) / F.size(long(s)) >= 0.70)
    ratio = F.size(F.filter(pieces, supported)) / F.size(pieces)
    empty = F.length(F.trim(whole)) == 0
    status = (
        F.when(refused, "SUPPORTED").when(empty | unseen, "UNSUPPORTED").when(ratio >= 0.75, "SUPPORTED").when(ratio >= 0.40, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    )
    score = F.when(status == "SUPPORTED", 1.0).when(status == "PARTIALLY_SUPPORTED", 0.5).otherwise(0.0)
    return F.struct(status.alias("status"), score.alias("score"), F.when(refused, 1.0).when(empty, 0.0).otherwise(F.round(ratio, 4)).alias("support_ratio"))


def refusal_outcome(refused: Column, requires_refusal: Column) -> Column:
    """M8: one of the four outcomes."""
    return F.when(requires_refusal & refused, "TRUE_REFUSAL").when(requires_refusal, "FALSE_ANSWER").when(refused, "FALSE_REFUSAL").otherwise("TRUE_ANSWER")


def error_type(correctness: Column, retrieved_gold: Column, citation_accuracy: Column, refused: Column, requires_refusal: Column) -> Column:
    """M9: what went wrong with an incorrect answer: REFUSAL, RETRIEVAL, GENERATION or CITATION; null if nothing."""
    return (
        F.when(refused != requires_refusal, "REFUSAL")
        .when(requires_refusal, None)
        .when((correctness != "CORRECT") & ~retrieved_gold, "RETRIEVAL")
        .when(correctness != "CORRECT", "GENERATION")
        .when(citation_accuracy < 1.0, "CITATION")
    )


def grouped_metrics(records: DataFrame, by: Sequence[str], metrics: Sequence[str], answerable: Column | None = None) -> DataFrame:
    """Means of ``metrics`` (over answerable rows if given), counts, and refusal and false-answer rates over the others."""
    asked = F.lit(True) if answerable is None else answerable
    means = [F.avg(F.when(asked, F.col(m))).alias(f"mean_{m}") for m in metrics]
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("n_answerable")]
    if answerable is not None:
        counts += [F.avg(F.when(~asked, F.col("refused").cast("double"))).alias("refusal_accuracy"), F.avg(F.when(~asked, 1 - F.col("refused").cast("double"))).alias("false_answer_rate")]
    return records.groupBy(*by).agg(*counts, *means)


def count_matrix(records: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts and percent of a row's total for each named value, zero cells kept."""
    cells = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    out = records.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *cells)
    return out.select(row, "total", *[c for v in values for c in (f"n_{v}", F.round(100.0 * F.col(f"n_{v}") / F.col("total"), 2).alias(f"pct_{v}"))])


def latency_profile(records: DataFrame, by: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """Per group count, share, mean, median, min, max and P95 by index (the element at min(int(0.95 n), n - 1)); nulls are left out. Exact, by ranges: a hot group takes many tasks."""
    return profile(records, by, value, share)


def paired_test(records: DataFrame, key: str, system: str, metric: str, a: str, b: str, by: Sequence[str] = (), zeros: str = "pratt") -> DataFrame:
    """Paired comparison of two systems over shared keys, one row per group of ``by``.

    Means, sample deviations, difference with its 95% interval, paired t, Cohen's d and the Wilcoxon signed-rank statistic with mean ranks for
    ties; zero differences are ranked and dropped (``pratt``) or dropped first (``wilcox``). p-values are two-sided: Student's t by
    ``p_value_t`` on the (few) result rows, Wilcoxon by the normal approximation.
    """
    side = lambda s, name: records.filter(F.col(system) == s).select(*by, key, F.col(metric).cast("double").alias(name))
    pairs = side(a, "va").join(side(b, "vb"), [*by, key]).withColumn("d", F.col("va") - F.col("vb"))
    n, mean, sd = F.count(F.lit(1)), F.avg("d"), F.stddev_samp("d")
    basic = pairs.groupBy(*by).agg(
        n.alias("n"), F.avg("va").alias("mean_a"), F.stddev_samp("va").alias("std_a"), F.avg("vb").alias("mean_b"), F.stddev_samp("vb").alias("std_b"),
        mean.alias("mean_diff"), sd.alias("std_diff"), (mean / (sd / F.sqrt(n))).alias("t_statistic"), (mean / F.when(sd > 1e-9, sd).otherwise(1.0)).alias("cohens_d"),
    )
    rows = pairs if zeros == "pratt" else pairs.filter("d <> 0")
    sizes = rows.groupBy(*by, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    before = F.sum("c").over(W.partitionBy(*by).orderBy("size")) - F.col("c")
    ranked = sizes.withColumn("r", before + (F.col("c") + 1) / 2.0)
    zero = F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("c"))), F.lit(0))
    total = F.sum("c")
    ties = F.sum(F.when(F.col("size") != 0, F.pow("c", F.lit(3)) - F.col("c")).otherwise(0.0))
    cube = lambda x: x * (x + 1) * (2 * x + 1)
    wil = ranked.groupBy(*by).agg(
        F.sum(F.col("r") * F.col("up")).alias("up"), F.sum(F.col("r") * F.col("down")).alias("down"),
        ((total * (total + 1) - zero * (zero + 1)) / 4.0).alias("mn"), F.sqrt((cube(total) - cube(zero) - ties / 2.0) / 24.0).alias("se"),
    )
    wil = wil.select(*by, F.least("up", "down").alias("wilcoxon_statistic"), ((F.least("up", "down") - F.col("mn")) / F.nullif("se", F.lit(0.0))).alias("wilcoxon_z"))
    return basic.join(wil, list(by), "left") if by else basic.crossJoin(F.broadcast(wil))  # one row each


def p_value_t(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / d
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


def confusion_metrics(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class precision, recall, F1 and support, and the accuracy and macro F1 of all."""
    cells = pairs.groupBy(F.col(gold).cast("string").alias("g"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    split = cells.select(F.explode(F.array(F.struct(F.col("g").alias("class"), F.lit("gold").alias("side")), F.struct(F.col("p").alias("class"), F.lit("pred").alias("side")))).alias("e"), "g", "p", "c")
    per = split.groupBy("e.class").agg(
        F.sum(F.when(F.col("e.side") == "gold", F.col("c")).otherwise(0)).alias("support"), F.sum(F.when(F.col("e.side") == "pred", F.col("c")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("e.side") == "gold") & (F.col("g") == F.col("p")), F.col("c")).otherwise(0)).alias("right"),
    )
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    per = per.withColumns({"precision": ratio("right", "predicted"), "recall": ratio("right", "support")})
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    every = W.partitionBy()
    return per.select("class", "support", "predicted", "right", "precision", "recall", "f1", (F.sum("right").over(every) / F.sum("support").over(every)).alias("accuracy"), F.avg("f1").over(every).alias("macro_f1"))


def compare_retrieval(direct: DataFrame, other: DataFrame, key: str, metric: str) -> DataFrame:
    """Per key the two values, their difference and IMPROVED, MAINTAINED or REGRESSED; a key absent on one side counts 0 there."""
    rows = direct.select(key, F.col(metric).alias("before")).join(other.select(key, F.col(metric).alias("after")), key, "full")
    rows = rows.select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    gain = F.col("after") - F.col("before")
    return rows.select("*", gain.alias("gain"), F.when(gain > 0, "IMPROVED").when(gain < 0, "REGRESSED").otherwise("MAINTAINED").alias("outcome"))


def paired_comparison(records: DataFrame, key: str, system: str, metric: str, systems: Sequence[str]) -> DataFrame:
    """One row per key with every system's value side by side and its difference to the first system's."""
    sides = records.groupBy(key).agg(*[F.max(F.when(F.col(system) == s, F.col(metric))).alias(s) for s in systems])
    return sides.select(key, *systems, *[(F.col(s) - F.col(systems[0])).alias(f"{s}_gain") for s in systems[1:]])


def score_distribution(records: DataFrame, by: Sequence[str], score: str, answerable: Column) -> DataFrame:
    """Counts at 1, 0.5 and 0, the share above 0, and the means over answerable and over all rows."""
    s = F.col(score)
    return records.groupBy(*by).agg(
        F.count_if(s == 1.0).alias("n_full"), F.count_if(s == 0.5).alias("n_half"), F.count_if(s == 0.0).alias("n_zero"), F.avg((s > 0).cast("double")).alias("share_above_zero"),
        F.avg(F.when(answerable, s)).alias("mean_answerable"), F.avg(s).alias("mean_all"),
    )


def multirun_stats(runs: DataFrame, by: Sequence[str], run: str, question: str, value: str, route: str) -> DataFrame:
    """Mean, population deviation, linear median and P95, deviation of the run means, and the share of questions with one distinct route."""
    base = runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"))
    means = runs.groupBy(*by, run).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.stddev_pop("m").alias("inter_run_std"))
    routes = runs.groupBy(*by, question).agg(F.countDistinct(route).alias("k")).groupBy(*by).agg(F.avg((F.col("k") == 1).cast("double")).alias("route_stability"))
    return base.join(means, list(by)).join(routes, list(by))


def stratified_pick(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Of each group every (size // n)-th row in ``order``, the first ``n`` of those."""
    w = W.partitionBy(by)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / n))
    placed = rows.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_step", step)
    return placed.filter((F.col("_at") % F.col("_step") == 0) & (F.floor(F.col("_at") / F.col("_step")) < n)).drop("_at", "_step")


def cost_matrix(tokens: DataFrame, by: Sequence[str], prices: DataFrame, scales: Sequence[int] = (1, 1000, 10_000, 100_000), rate: float = 25_400.0) -> DataFrame:
    """Token statistics per group, and for each row of ``prices`` (model, usd_in, usd_out per million) the cost of so many queries in dollars and local currency.

    ``prices`` is a list of models, one row each; the groups are aggregated first.
    """
    stats = tokens.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("input_tokens", "output_tokens") for n, f in (("mean", F.avg), ("sum", F.sum), ("least", F.min), ("most", F.max))])
    one = (F.col("mean_input_tokens") * F.col("usd_in") + F.col("mean_output_tokens") * F.col("usd_out")) / 1e6
    costs = [c for k in scales for c in ((one * k).alias(f"usd_{k}"), (one * k * rate).alias(f"local_{k}"))]
    return stats.join(prices.hint("broadcast"), F.lit(True)).select(*stats.columns, "model", *costs)


def conditional_rates(records: DataFrame, by: Sequence[str], flags: Sequence[str], of: dict[str, str] | None = None) -> DataFrame:
    """The share of rows with each flag; a flag named in ``of`` counts over the rows that have the other flag."""
    of = of or {}
    share = lambda f: F.avg(F.when(F.col(of[f]), F.col(f).cast("double")) if f in of else F.col(f).cast("double"))
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[share(f).alias(f"rate_{f}") for f in flags])


