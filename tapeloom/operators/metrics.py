"""Probability scoring and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEY
from ..functions.columns import first_argmax
from .ordering import exact_quantiles

CLASSES = 3
FLOOR = 1e-12


def true_probability(label: str = "label", p: str = "p") -> Column:
    return F.element_at(F.col(p), (F.col(label) + 1).cast("int"))


def row_nll(label: str = "label", p: str = "p") -> Column:
    return -F.log(F.greatest(true_probability(label, p), F.lit(FLOOR)))


def row_brier(label: str = "label", p: str = "p") -> Column:
    parts = [F.pow(F.col(p)[k] - F.when(F.col(label) == k, 1.0).otherwise(0.0), 2) for k in range(CLASSES)]
    return parts[0] + parts[1] + parts[2]


def class_metrics(pred: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    """Loss, accuracies, macro F1, Brier, confusion and support per ``keys``, in one aggregate.

    A class that never occurs has recall and F1 of zero and still counts in the macro means.
    """
    scored = pred.withColumns({"_g": first_argmax(F.col(p)), "_nll": row_nll(label, p), "_b": row_brier(label, p)})
    cells = [
        F.count_if((F.col(label) == i) & (F.col("_g") == j)).alias(f"confusion_{i}{j}") for i in range(CLASSES) for j in range(CLASSES)
    ]
    grouped = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("examples"), F.avg("_nll").alias("nll"), F.avg("_b").alias("brier"), *cells)
    c = lambda i, j: F.col(f"confusion_{i}{j}")
    support = [sum((c(i, j) for j in range(1, CLASSES)), c(i, 0)) for i in range(CLASSES)]
    guesses = [sum((c(i, j) for i in range(1, CLASSES)), c(0, j)) for j in range(CLASSES)]
    recall = [F.when(support[k] > 0, c(k, k) / support[k]).otherwise(0.0) for k in range(CLASSES)]
    f1 = [F.when(support[k] + guesses[k] > 0, 2 * c(k, k) / (support[k] + guesses[k])).otherwise(0.0) for k in range(CLASSES)]
    return grouped.withColumns(
        {
            "accuracy": (c(0, 0) + c(1, 1) + c(2, 2)) / F.col("examples"),
            "balanced_accuracy": (recall[0] + recall[1] + recall[2]) / CLASSES,
            "macro_f1": (f1[0] + f1[1] + f1[2]) / CLASSES,
            **{f"support_{k}": support[k] for k in range(CLASSES)},
        }
    )


def bad_probabilities(pred: DataFrame, tolerance: float = 1e-6, p: str = "p") -> DataFrame:
    """Count of rows whose probabilities are not three finite non-negative numbers that sum to one."""
    values = F.col(p)
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    good = (F.size(values) == CLASSES) & finite & (F.abs(total - 1) <= tolerance)
    return pred.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("invalid"))


def check_probs(pred: DataFrame, tolerance: float = 1e-6) -> None:
    n = bad_probabilities(pred, tolerance).first().invalid
    if n:
        raise ValueError(f"{n} rows have invalid probabilities")


def predictions(pred: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    return pred.select(
        *keys, label, *[F.col(p)[k].alias(f"p{k}") for k in range(CLASSES)], first_argmax(F.col(p)).alias("predicted"), row_nll(label, p).alias("nll")
    )


def class_prior(labelled: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Laplace-smoothed class shares per ``keys`` as array ``p``."""
    n = F.count(F.lit(1)) + CLASSES
    shares = [((F.count_if(F.col(label) == k) + 1) / n) for k in range(CLASSES)]
    return labelled.groupBy(*keys).agg(F.array(*shares).alias("p"))


def nll_summary(scores: DataFrame, keys: Sequence[str], session: Sequence[str] = KEY) -> DataFrame:
    """Mean over events, mean of session means, and the number of events: two small aggregates."""
    per_session = scores.groupBy(*keys, *session).agg(F.sum("nll").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per_session.groupBy(*keys).agg(
        (F.sum("_s") / F.sum("_n")).alias("nll_per_event"),
        F.avg(F.col("_s") / F.col("_n")).alias("session_macro_nll"),
        F.sum("_n").alias("evaluated_events"),
    )


def session_nll(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys, *KEY).agg(F.avg("nll").alias("mean_nll"), F.count(F.lit(1)).alias("n"))


def calibration(pred: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    shares = [F.avg(F.col(p)[k]).alias(f"predicted_class{k}") for k in range(CLASSES)]
    seen = [F.avg((F.col(label) == k).cast("double")).alias(f"observed_class{k}") for k in range(CLASSES)]
    return pred.groupBy(*keys).agg(
        F.avg(row_brier(label, p)).alias("brier"),
        F.avg((first_argmax(F.col(p)) == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(F.array_max(F.col(p))).alias("mean_confidence"),
        *shares,
        *seen,
    )


def class_fractions(distribution: DataFrame, keys: Sequence[str] = ("task", "split")) -> DataFrame:
    sums = distribution.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"class_{k}").alias(f"class_{k}") for k in range(CLASSES)])
    return sums.withColumns({f"fraction_{k}": F.col(f"class_{k}") / F.col("n") for k in range(CLASSES)})


def exclusion_totals(per_session: DataFrame, reasons: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in ("candidates", "retained", *reasons)])
    return per_session.select("split", F.inline(pairs)).groupBy("split", "reason").agg(F.sum("n").alias("n"))


def span_stats(examples: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Minimum, exact median and maximum of ``value`` per split. One column per split, so no split is gathered."""
    split_columns = {g: F.when(F.col("split") == g, F.col(value)) for g in groups}
    wide = examples.select(*[column.alias(g) for g, column in split_columns.items()])
    row = wide.agg(*[f(g).alias(f"{n}_{g}") for g in groups for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    present = [g for g in groups if row[f"n_{g}"]]
    medians = exact_quantiles(wide, {g: [0.5] for g in present}, {g: row[f"n_{g}"] for g in present})
    rows = [(g, row[f"lo_{g}"], medians[g][0], row[f"hi_{g}"]) for g in present]
    return examples.sparkSession.createDataFrame(rows, "split string, low double, median double, high double")


def label_distribution(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy("split").pivot(label, list(range(CLASSES))).count().na.fill(0).withColumnsRenamed(
        {str(k): f"label_{k}" for k in range(CLASSES)}
    )
