"""Metrics of detectors and classifiers, as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio
from ..functions.ranking import cumulative_by_value, string_at_rank, value_at_rank

POSITIVE = "anomaly"


def _truth(label: str = "label") -> Column:
    return F.col(label) == POSITIVE


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(2 * precision * recall, precision + recall),
        "false_positive_rate": ratio(fp, fp + tn),
        "detection_rate": recall,
    }


def binary_metrics(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    """One row: counts and rates at a threshold; rates with denominator zero are zero."""
    hit, truth = F.col(score) >= threshold, _truth()
    counts = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(truth).alias("actual_anomalies"),
        F.count_if(hit).alias("predicted_anomalies"),
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & ~truth).alias("tn"), F.count_if(~hit & truth).alias("fn"),
    )
    return counts.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def _per_score(df: DataFrame, score: str) -> DataFrame:
    truth = _truth()
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )


def roc_auc(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores share their rank. 0 if a class is missing."""
    cumulative = cumulative_by_value(_per_score(df, score), "score", {"neg": "neg_upto"})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos") * F.sum("neg")
    return cumulative.agg(F.coalesce(ratio(wins, pairs), F.lit(0.0)).alias("roc_auc"))


def precision_recall_curve(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Precision and recall at every distinct score, highest first, as cumulative counts."""
    return cumulative_by_value(_per_score(df, score), "score", {"pos": "tp", "neg": "fp"}, descending=True)


def pr_auc(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Trapezoids under the precision-recall curve, from recall 0 at precision 1.

    The point before a row is rebuilt from its own counts, so no second ordering is needed.
    """
    curve = precision_recall_curve(df, score)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    area = F.sum(F.col("pos") * (precision + before) / 2.0)
    return curve.agg(F.coalesce(ratio(area, F.sum("pos")), F.lit(0.0)).alias("pr_auc"))


def top_budget(df: DataFrame, share: float = 0.01, score: str = "anomaly_score") -> DataFrame:
    """Precision and recall of alerting on the top share of scores; equal scores go by event id.

    The budget grows with the data, so the score at its edge is found by counting, and only rows tied with it are
    ordered.
    """
    df = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    n, lo, hi = df.agg(F.count(score), F.min(score), F.max(score)).first()
    truth = _truth()
    if n == 0:
        zero = F.lit(0.0)
        return df.agg(F.count(score).alias("alerts_triggered"), F.max(zero).alias("top_precision"), F.max(zero).alias("top_recall")).fillna(0.0)
    k = max(1, int(n * share))
    edge, below, tied = value_at_rank(df, F.col(score), [n - k], lo, hi)[n - k]
    left = k - (n - below - tied)
    chosen = F.col(score) > edge
    if left == tied:
        chosen = F.col(score) >= edge
    elif left > 0:
        last = string_at_rank(df.where(F.col(score) == edge), "event_id", left - 1, tied)
        chosen = chosen | ((F.col(score) == edge) & (F.col("event_id") <= last))
    hits = F.count_if(chosen & truth)
    return df.agg(
        F.count_if(chosen).alias("alerts_triggered"),
        ratio(hits, F.count_if(chosen)).alias("top_precision"),
        ratio(hits, F.count_if(truth)).alias("top_recall"),
    )


def per_class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # Each confusion cell speaks for its true class and for its predicted class.
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )).alias("_s")
    per_class = counts.select(sides).select("_s.*").groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1_score"), "support", "tp",
    )


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and weighted and macro averages over the classes."""
    n = F.sum("support")
    return per_class_report(df, truth, predicted).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / n).alias("weighted_f1"),
        F.avg("f1_score").alias("macro_f1"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    pivoted = df.groupBy(F.col(truth).alias("y_true")).pivot(predicted, classes).agg(F.count(F.lit(1)))
    return pivoted.fillna(0)


def long_metrics(row: DataFrame) -> DataFrame:
    """A one-row metrics frame as (metric, value)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ])
    return row.select(F.explode(pairs).alias("_m")).select("_m.*")


def report_text(metrics: DataFrame) -> DataFrame:
    """Text report of a long metrics frame, one line per metric."""
    line = F.format_string("%-24s %.4f", "metric", "value")
    return metrics.select("metric", line.alias("line"))


def full_report(metrics: DataFrame, per_class: DataFrame, confusion: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """The report's lines with their place: sections of metrics, classes, confusion (a line for each true class) and importances."""
    counts = [c for c in confusion.columns if c != "y_true"]
    sections = [
        report_text(metrics).withColumnRenamed("metric", "item"),
        per_class.select(F.col("class").alias("item"), F.format_string("%-24s %.4f %.4f %.4f %d", "class", "precision", "recall", "f1_score", "support").alias("line")),
        confusion.select(F.col("y_true").alias("item"), F.format_string("%-24s" + " %d" * len(counts), "y_true", *counts).alias("line")),
    ]
    if importances is not None:
        sections.append(importances.select(F.col("feature").alias("item"), F.format_string("%-40s %.6f", "feature", "importance").alias("line")))
    names = ["metrics", "classes", "confusion", "importances"]
    out = None
    for place, (name, section) in enumerate(zip(names, sections)):
        part = section.select(F.lit(place).alias("place"), F.lit(name).alias("section"), "item", "line")
        out = part if out is None else out.unionByName(part)
    return out
