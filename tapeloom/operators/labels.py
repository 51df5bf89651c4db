"""Event-time labels and history features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEY
from .events import running_by_symbol
from .ordering import framed, positions, spread
from .windows import evaluation_subset


def direction(change: Column, band: float) -> Column:
    """0 down, 1 inside the band (its ends included), 2 up."""
    return F.when(change < -band, 0).when(change > band, 2).otherwise(1).cast("int")


def future_labels(events: DataFrame, horizon: int, band: float) -> DataFrame:
    """Return and elapsed seconds over the next ``horizon`` events of each event that has them all."""

    def columns(w):
        ahead = w.rowsBetween(1, horizon)
        return {
            "future_log_return_bps": F.sum("f1").over(ahead),
            "horizon_seconds": F.sum(F.expm1("f0")).over(ahead),
        }

    labelled = framed(events, KEY, "e", columns, after=horizon).where(F.col("e") + horizon < F.col("events"))
    return labelled.withColumn("label", direction(F.col("future_log_return_bps"), band))


def is_anchor(context: int, horizon: int) -> Column:
    """Anchors ``context - 1 + k * (context + horizon)`` whose whole horizon lies in the session."""
    e = F.col("e")
    return (e >= context - 1) & ((e - (context - 1)) % (context + horizon) == 0) & (e < F.col("events") - horizon)


def event_examples(
    events: DataFrame, context: int, horizon: int, band: float, widths: tuple[int, ...] = (5, 20), tokens: str | None = None
) -> DataFrame:
    """One row per non-overlapping anchor: its history features, label and, with ``tokens``, its context.

    Input and label windows of consecutive anchors tile the session, so an example is one block of
    ``context + horizon`` events and everything about it is one grouped aggregate.
    """
    block = context + horizon
    at = F.col("e") % block
    past, ahead = at < context, at >= context

    def over(width: int, value: Column) -> Column:
        return F.when(past & (at >= context - min(width, context)), value)

    history = [F.max(F.when(at == context - 1, F.col(f))).cast("float").alias(f"last_{f}") for f in ("f0", "f1", "f2")]
    for i, width in enumerate((*widths, context)):
        r, dt, size = (over(width, F.col(f)) for f in ("f1", "f0", "f2"))
        name = str(width) if i < len(widths) else "context"
        history += [
            F.sum(r).cast("float").alias(f"return_sum_{name}"),
            F.stddev_pop(r).cast("float").alias(f"return_std_{name}"),
            F.avg(F.abs(r)).cast("float").alias(f"return_abs_{name}"),
            F.avg(dt).cast("float").alias(f"interval_mean_{name}"),
            F.avg(size).cast("float").alias(f"size_mean_{name}"),
            F.stddev_pop(size).cast("float").alias(f"size_std_{name}"),
        ]
    codes = [F.sort_array(F.collect_list(F.when(past, F.struct("e", tokens)))).alias("_codes")] if tokens else []
    grouped = events.groupBy(*KEY, "split", F.floor(F.col("e") / block).alias("ordinal")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(ahead, F.col("f1"))).alias("future_log_return_bps"),
        F.sum(F.when(ahead, F.expm1("f0"))).alias("horizon_seconds"),
        *history,
        *codes,
    )
    start = F.col("ordinal") * block
    complete = grouped.where(F.col("_n") == block).withColumns(
        {
            "input_start": start,
            "anchor": start + context - 1,
            "label_end": start + block - 1,
            "label": direction(F.col("future_log_return_bps"), band),
        }
    )
    if tokens:
        complete = complete.withColumn("tokens", F.col(f"_codes.{tokens}")).drop("_codes")
    return complete.drop("_n")


def example_totals(sessions: DataFrame, context: int, horizon: int) -> DataFrame:
    """Anchors per session by arithmetic, and their exclusive running sum within the split as ``first``."""
    counted = sessions.withColumn("anchors", F.floor(F.col("events") / (context + horizon)).cast("bigint"))
    return running_by_symbol(counted, "anchors", "first")


def index_examples(examples: DataFrame, totals: DataFrame) -> DataFrame:
    """Dense ``example_index`` per split in (symbol, date, anchor) order, without ordering the examples."""
    sizes = totals.where("anchors > 0").select(*KEY, F.col("anchors").alias("rows"))
    joined = spread(examples, totals.select(*KEY, "first"), KEY, "ordinal", sizes)
    return joined.withColumn("example_index", F.col("first") + F.col("ordinal")).drop("first")


def cap_examples(indexed: DataFrame, totals: DataFrame, maximum: int) -> DataFrame:
    """All training examples, and at most ``maximum`` evenly spaced ones of every other split."""
    n = totals.where("split <> 'train'").groupBy("split").agg(F.sum("anchors").alias("n"))
    picked = evaluation_subset(n, maximum, "example_index")
    others = indexed.join(F.broadcast(picked), ["split", "example_index"], "left_semi")
    return indexed.where("split = 'train'").unionByName(others)


def number_examples(examples: DataFrame) -> DataFrame:
    """Dense index of any example set per split, by order of (symbol, date, anchor)."""
    return positions(examples, ["split"], [*KEY, "anchor"], "example_index")


def context_codes(points: DataFrame, coded: DataFrame, context: int, last: str = "e", value: str = "token") -> DataFrame:
    """The ``context`` codes that end at each point's event ``last``; points carry key and ``anchor``."""
    wanted = points.select(*KEY, "anchor", F.explode(F.sequence(F.col(last) - (context - 1), F.col(last))).alias("e"))
    found = wanted.join(coded.select(*KEY, "e", value), [*KEY, "e"])
    return found.groupBy(*KEY, "anchor").agg(F.sort_array(F.collect_list(F.struct("e", value))).alias("_c")).select(
        *KEY, "anchor", F.col(f"_c.{value}").alias("tokens")
    )
