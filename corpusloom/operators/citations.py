"""Citation metrics: predicted against gold references, one record a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def citation_metrics(records: DataFrame, granularity: str = "strict") -> DataFrame:
    """Adds hits, recall, precision and f1 to rows with arrays ``predicted`` and ``gold`` and int ``parse_errors``.

    ``article`` compares identifiers without what follows the article. Parse errors enlarge the
    precision's denominator. Without gold recall is null; without predictions precision is 0 if
    there is gold, else null. F1 is of the rounded values, null where one is.
    """
    cut = lambda c: F.transform(c, lambda x: F.regexp_extract(x, r"^([^.]+\.A\d+)", 1))
    pred, gold = F.array_distinct("predicted"), F.array_distinct("gold")
    if granularity == "article":
        pred, gold = F.array_distinct(cut(pred)), F.array_distinct(cut(gold))
    rows = records.withColumns({"hits": F.size(F.array_intersect(pred, gold)), "n_gold": F.size(gold), "n_pred": F.size(pred) + F.col("parse_errors")})
    precision = F.when(F.col("n_pred") > 0, F.col("hits") / F.col("n_pred")).when(F.col("n_gold") > 0, 0.0)
    rows = rows.withColumns({"recall": F.round(F.try_divide("hits", "n_gold"), 4), "precision": F.round(precision, 4)})
    total = F.col("recall") + F.col("precision")
    return rows.withColumn("f1", F.when(total > 0, F.round(2 * F.col("recall") * F.col("precision") / total, 4)).when(total == 0, 0.0))


MACRO = ("recall", "precision", "f1", "display", "bertscore_p", "bertscore_r", "bertscore_f1", "rouge1", "rouge2", "rougeL", "bleu", "latency_s")
DEVIATION = ("recall", "precision", "f1", "display", "bertscore_f1", "rougeL", "bleu", "latency_s")


def reliability(records: DataFrame) -> DataFrame:
    """Adds first_try, repaired and repair_success from ``prolog_success`` and ``n_repair_rounds``; null if a record has neither."""
    told = F.col("prolog_success").isNotNull() | F.col("n_repair_rounds").isNotNull()
    success, rounds = F.coalesce("prolog_success", F.lit(False)), F.coalesce("n_repair_rounds", F.lit(0))
    return records.withColumns({"first_try": F.when(told, success & (rounds == 0)), "repaired": F.when(told, rounds >= 1), "repair_success": F.when(told & (rounds >= 1), success)})


def reliability_rates(records: DataFrame, by: str) -> DataFrame:
    """Rates of first tries and repairs among records that tell, and of repairs that succeeded among the repaired."""
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit), of), 4)
    n, repaired = F.count("first_try"), F.count_if("repaired")
    return records.groupBy(by).agg(n.alias("n_prolog_records"), rate("first_try", n).alias("first_try_rate"), rate("repaired", n).alias("repair_rate"), rate("repair_success", repaired).alias("repair_success_rate"), F.count_if("repair_success").alias("repair_success_num"), repaired.alias("repair_success_denom"))


def citation_summary(scored: DataFrame, by: str) -> DataFrame:
    """Macro means and sample deviations of the columns there are, micro rates and error counts, for each arm."""
    have = set(scored.columns)
    micro = lambda top, bottom, name: F.round(F.try_divide(F.sum(top), F.sum(bottom)), 4).alias(name)
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_records"),
        *(F.round(F.avg(c), 4).alias(f"macro_{c}") for c in MACRO if c in have),
        *(F.round(F.stddev_samp(c), 4).alias(f"std_{c}") for c in DEVIATION if c in have),
        micro("hits", "n_gold", "micro_recall"),
        micro("hits", "n_pred", "micro_precision"),
        *([micro("display_num", "display_denom", "micro_display")] if "display_num" in have else []),
        F.sum("parse_errors").alias("parse_errors"),
        F.count_if(F.col("n_pred") == 0).alias("without_predictions"),
    )


def display_rate(records: DataFrame) -> DataFrame:
    """Adds display_num, display_denom and ``display``: how many distinct predicted references an answer displays.

    Of all distinct predicted references and those that couldn't be parsed. ``shown`` lists the
    displayed ones, if the records have it; else a displayed identifier shows itself and what it lies in.
    """
    if "shown" in records.columns:
        shown = F.array_distinct("shown")
    else:
        shown = F.filter(F.array_distinct("predicted"), lambda p: F.exists("displayed", lambda d: (d == p) | F.startswith(d, F.concat(p, F.lit(".")))))
    rows = records.withColumns({"display_num": F.size(shown), "display_denom": F.size(F.array_distinct("predicted")) + F.col("parse_errors")})
    return rows.withColumn("display", F.round(F.try_divide("display_num", "display_denom"), 4))


def gold_items(records: DataFrame) -> DataFrame:
    """Records with ``gold_items`` and ``gold_articles`` from whichever of the two they have, and a number from 1 for each arm.

    A record with neither raises when it is read.
    """
    items, articles = F.col("gold_items"), F.col("gold_articles")
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))
    given = F.coalesce(F.when(F.size(items) > 0, items), articles, items)
    checked = F.when(items.isNull() & articles.isNull(), F.raise_error(F.lit("a record has neither gold items nor gold articles")).cast("array<string>")).otherwise(clean(given))
    derived = F.array_distinct(F.transform("gold_items", lambda x: F.element_at(F.split(x, r"\.K"), 1)))
    rows = records.withColumn("_articles", clean(articles)).withColumn("gold_items", checked)
    return rows.withColumn("gold_articles", F.when(F.size("_articles") > 0, F.col("_articles")).otherwise(derived)).drop("_articles")


def leaderboard(summary: DataFrame, arm: str, metric: str, baseline: str) -> DataFrame:
    """Arms by ``metric``, with their rank and whether to adopt them: no worse than ``baseline``."""
    base = F.broadcast(summary.where(F.col(arm) == baseline).select(F.col(metric).alias("_base")).limit(1))
    above = summary.select(F.col(metric).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    better = summary.join(F.broadcast(above), F.col("_m") > F.col(metric), "left").groupBy(*summary.columns).agg((F.coalesce(F.sum("_n"), F.lit(0)) + 1).alias("rank"))
    return better.crossJoin(base).withColumn("adopt", F.col(metric) >= F.col("_base")).drop("_base")
