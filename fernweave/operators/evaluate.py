"""Evaluation: exact match, token F1, recall and precision by content and by id, gates, the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def token_f1(cases: DataFrame, case: str = "case_id", prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(case, f1): harmonic mean of precision and recall over the multiset of normal words; 0 if either is empty."""
    words = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != "")
    d = cases.select(case, words(prediction).alias("p"), words(reference).alias("r"))
    count = lambda c: d.select(case, F.explode(c).alias("w")).groupBy(case, "w").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    common = count("p").join(count("r"), [case, "w"]).groupBy(case).agg(F.sum(F.least("n_p", "n_r")).alias("both"))
    f1 = F.when(F.coalesce("both", F.lit(0)) == 0, 0.0).otherwise(2.0 * F.col("both") / (F.size("p") + F.size("r")))
    return d.join(common, case, "left").select(case, f1.alias("f1"))


def content_recall_precision(cases: DataFrame, k: int = 5) -> DataFrame:
    """Rows (case_id, rank, content, reference): recall is 1 if any of the first k holds the reference, precision
    the share of them that do."""
    hit = F.instr(normalize_answer(F.col("content")), normalize_answer(F.col("reference"))) > 0
    return cases.filter(F.col("rank") <= k).groupBy("case_id").agg(F.max(hit.cast("double")).alias("recall"), F.avg(hit.cast("double")).alias("precision"))


def id_recall_precision(expected: Column, retrieved: Column) -> tuple[Column, Column]:
    """By ids: recall 1 if any expected one is there; precision the share of those retrieved; null without expected."""
    hits = F.size(F.filter(retrieved, lambda x: F.array_contains(expected, x)))
    any_expected = F.size(expected) > 0
    return F.when(any_expected, (hits > 0).cast("double")), F.when(any_expected, F.when(F.size(retrieved) > 0, hits / F.size(retrieved)).otherwise(0.0))


def report(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of (em, f1, recall, precision, grounding) cases: means, and failures (F1 below the threshold or
    ungrounded). Means of recall and precision are null unless all cases have them."""
    mean_of_all = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    failed = (F.col("f1") < threshold) | (F.coalesce(F.col("grounding"), F.lit("")) == "ungrounded")
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("em").alias("mean_em"), F.avg("f1").alias("mean_f1"), mean_of_all("recall").alias("mean_recall"), mean_of_all("precision").alias("mean_precision"), F.count_if(failed).alias("n_failed"))


def score_gate(hits: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """Whether the best score reaches the threshold."""
    return hits.groupBy(key).agg(F.max("score").alias("best")).withColumn("passed", F.col("best") >= threshold)


def token_f1_best(cases: DataFrame, case: str = "case_id", prediction: str = "prediction", references: str = "references") -> DataFrame:
    """(case, f1): the best token F1 over several reference answers; 0 without any."""
    each = cases.select(case, prediction, F.posexplode_outer(references).alias("_i", "reference"))
    keyed = each.withColumn("_case", F.struct(case, "_i"))
    scored = token_f1(keyed.fillna("", ["reference"]), "_case", prediction, "reference")
    return scored.groupBy(F.col(f"_case.{case}").alias(case)).agg(F.max("f1").alias("f1"))


def judged(cases: DataFrame, judge, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Adds ``judgment`` (from 0 to 1) by a plug-in that gets prediction and reference; what fails is null, with ``error``."""
    import json

    from ..plugins import mapped

    asked = cases.withColumn("_asked", F.to_json(F.struct(F.col(prediction).alias("p"), F.col(reference).alias("r"))))
    out = mapped(asked, lambda x: str(float(judge(json.loads(x).get("p"), json.loads(x).get("r")))), "_asked")
    value = F.col("value").cast("double")
    return out.withColumn("judgment", F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))).drop("value", "_asked")


def relevance_gate(contexts: DataFrame, relevant, best: str = "best", threshold: float = 0.5, text: str = "context") -> DataFrame:
    """Adds ``passed``: what a plug-in says of each query's context; where it fails, whether the best score reaches the
    threshold."""
    from ..plugins import mapped

    out = mapped(contexts, lambda x: str(bool(relevant(x))).lower(), text)
    return out.withColumn("passed", F.coalesce(F.col("value").cast("boolean"), F.col(best) >= threshold, F.lit(False))).drop("value")


def measured(cases: DataFrame, metrics: dict[str, Callable[[Column, Column], Column]], prediction: str = "prediction", reference: str = "reference") -> tuple[DataFrame, DataFrame]:
    """Metrics of one's own, by name: functions of two columns to a number. The cases with a column each, and one row of
    their means over the cases that have a value."""
    each = cases.withColumns({name: fn(F.col(prediction), F.col(reference)).cast("double") for name, fn in metrics.items()})
    return each, each.agg(F.count(F.lit(1)).alias("n_cases"), *[F.avg(name).alias(name) for name in metrics])
