"""Scores of detectors against labelled corpora, gates, and the bypass ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv

_MEASURED_SUFFIX = r"\s*\(\s*[\d.]+\s*(ms|s|us|µs)\s*\)\s*$"


def _cell_counts(is_attack: Column, detected: Column) -> list[Column]:
    return [
        F.count_if(is_attack & detected).alias("tp"), F.count_if(~is_attack & detected).alias("fp"),
        F.count_if(~is_attack & ~detected).alias("tn"), F.count_if(is_attack & ~detected).alias("fn"),
    ]


def confusion(cases: DataFrame, by: str, is_attack: str, detected: str) -> DataFrame:
    return cases.groupBy(by).agg(*_cell_counts(F.col(is_attack), F.col(detected)))


def _share(part: Column, whole: Column, when_empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(when_empty))


def with_scores(cells: DataFrame, recall_when_empty: float = 1.0) -> DataFrame:
    """Add block_rate, fp_rate, precision, recall, f1 and youden (rates and f1 in percent) to confusion cells."""
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    scored = cells.withColumns(
        {
            "block_rate": _share(tp, tp + fn, 0.0) * 100, "fp_rate": _share(fp, fp + tn, 0.0) * 100,
            "precision": _share(tp, tp + fp, 1.0), "recall": _share(tp, tp + fn, recall_when_empty),
        }
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumns(
        {
            "f1": F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / both * 100).otherwise(0.0),
            "youden": F.col("block_rate") - F.col("fp_rate"),
        }
    )


def score_by_category(cases: DataFrame, by: str, is_attack: str, detected: str) -> DataFrame:
    return with_scores(confusion(cases, by, is_attack, detected))


def score_overall(cases: DataFrame, by: str, is_attack: str, detected: str) -> DataFrame:
    """Rows 'micro' (scores of all cases together) and 'macro' (mean of the category scores), from one pass over the cases."""
    names, cells = ["block_rate", "fp_rate", "f1", "youden"], ("tp", "fp", "tn", "fn")
    macro = F.struct(F.sum(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("cases"), *[F.avg(name).alias(name) for name in names])
    together = score_by_category(cases, by, is_attack, detected).agg(
        *[F.coalesce(F.sum(cell), F.lit(0)).cast("bigint").alias(cell) for cell in cells], macro.alias("_macro")
    )
    micro = F.struct(F.lit("micro").alias("average"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("cases"), *names)
    mean = F.struct(F.lit("macro").alias("average"), F.col("_macro.cases").alias("cases"), *[F.col(f"_macro.{name}").alias(name) for name in names])
    return with_scores(together).select(F.inline(F.array(micro, mean)))


def gate_violations(
    scores: DataFrame, min_block_rate: float = fv.MIN_BLOCK_RATE, max_fp_rate: float = fv.MAX_FALSE_POSITIVE_RATE
) -> DataFrame:
    low, high = F.col("block_rate") < min_block_rate, F.col("fp_rate") > max_fp_rate
    reason = F.concat_ws(
        "; ", F.when(low, "block rate below gate"), F.when(high, "false positive rate above gate")
    )
    return scores.withColumn("violation", reason).where(low | high)


def rating_band(score: Column) -> Column:
    chain = None
    for bound, band in fv.RATING_BANDS:
        chain = F.when(score >= bound, band) if chain is None else chain.when(score >= bound, band)
    return chain.otherwise("Grade C / D")


def stable_name(name: Column) -> Column:
    """Case name without a measured duration at its end."""
    return F.trim(F.regexp_replace(name, _MEASURED_SUFFIX, ""))


def ratchet(bypasses: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare bypassed cases (harness, name) with the baseline (harness, max_bypasses, total, name), per harness.

    Status: OK, REGRESSED (more than allowed), IMPROVED (fewer), CHANGED (as many but others), NO_BASELINE.
    """
    current = bypasses.select("harness", stable_name(F.col("name")).alias("name"), F.lit(True).alias("_now")).distinct()
    limits = baseline.groupBy("harness").agg(F.max("max_bypasses").alias("allowed"))
    known = (
        baseline.where("name is not null")
        .select("harness", stable_name(F.col("name")).alias("name"), F.lit(True).alias("_known"))
        .distinct()
    )
    compared = current.join(known, ["harness", "name"], "full_outer").groupBy("harness").agg(
        F.count_if(F.col("_now")).alias("bypassed"),
        F.count_if(F.col("_now") & F.col("_known").isNull()).alias("new"),
        F.count_if(F.col("_known") & F.col("_now").isNull()).alias("fixed"),
    )
    joined = compared.join(limits, "harness", "full_outer").fillna(0, ["bypassed", "new", "fixed"])
    status = (
        F.when(F.col("allowed").isNull(), "NO_BASELINE")
        .when(F.col("bypassed") > F.col("allowed"), "REGRESSED")
        .when(F.col("bypassed") < F.col("allowed"), "IMPROVED")
        .when(F.col("new") > 0, "CHANGED")
        .otherwise("OK")
    )
    return joined.withColumn("status", status)


def ratchet_cases(bypasses: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases that differ from the baseline: NEW bypasses and FIXED ones."""
    current = bypasses.select("harness", stable_name(F.col("name")).alias("name")).distinct()
    known = baseline.where("name is not null").select("harness", stable_name(F.col("name")).alias("name")).distinct()
    return current.exceptAll(known).withColumn("change", F.lit("NEW")).unionByName(
        known.exceptAll(current).withColumn("change", F.lit("FIXED"))
    )


def false_positives(cases: DataFrame, is_attack: str, rule: str) -> DataFrame:
    """Benign cases hit, by rule."""
    return cases.where(~F.col(is_attack) & (F.col(rule) != "")).groupBy(rule).agg(F.count("*").alias("n"))


def shielded_comparison(models: DataFrame, cases: DataFrame, is_attack: str, detected: str) -> DataFrame:
    """Each model's own defence (given by the user) next to the measured shielded rates.

    The measured side is one aggregate row, taken as a scalar subquery.
    """
    measured = with_scores(cases.agg(*_cell_counts(F.col(is_attack), F.col(detected)))).select(
        F.struct(F.col("block_rate").alias("shielded_defense"), "fp_rate", F.col("f1").alias("f1_score"))
    )
    native = (F.col("native_pi_defense") + F.col("native_jb_defense")) / 2 * 100
    compared = models.withColumns({"native_defense": native, "_measured": measured.scalar()})
    uplift = F.col("_measured.shielded_defense") - F.col("native_defense")
    return compared.select("*", "_measured.*", uplift.alias("uplift")).drop("_measured")


def with_overhead(models: DataFrame, overhead_ms: float | Column, base: str = "avg_base_latency_ms") -> DataFrame:
    """Add total_latency_ms and overhead_pct for an overhead on top of a base latency."""
    overhead = overhead_ms if isinstance(overhead_ms, Column) else F.lit(overhead_ms)
    return models.withColumns(
        {"total_latency_ms": F.col(base) + overhead, "overhead_pct": overhead / F.col(base) * 100}
    )
