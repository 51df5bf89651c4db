"""Fixed-length windows, sampling and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEY
from ..functions.columns import draw
from .events import running_by_symbol
from .ordering import framed


def window_counts(sessions: DataFrame, context: int, stride: int = 1) -> DataFrame:
    """Windows per session and their half-open range ``[first, last)`` in the split's numbering."""
    n = F.greatest(F.lit(0), F.floor((F.col("events") - context - 1) / stride) + 1)
    counted = sessions.withColumn("windows", F.when(F.col("events") > context, n).otherwise(F.lit(0)).cast("bigint"))
    return running_by_symbol(counted, "windows", "first").withColumn("last", F.col("first") + F.col("windows"))


def windows(coded: DataFrame, context: int, stride: int = 1, value: str = "token") -> DataFrame:
    """Every window of ``context + 1`` consecutive events of one session, as (key, start, tokens).

    With a wide stride each event is sent to the few windows that hold it; with a narrow one, a frame
    over chunks avoids copying an event ``context`` times.
    """
    length = context + 1
    if 2 * stride >= length:
        top = F.floor(F.col("e") / stride)
        low = F.greatest(F.lit(0), F.ceil((F.col("e") - context) / stride))
        fits = lambda k: k * stride + context < F.col("events")
        spread = coded.withColumn("_k", F.explode(F.filter(F.when(low <= top, F.sequence(low, top)), fits)))
        grouped = spread.groupBy(*KEY, "split", (F.col("_k") * stride).alias("start")).agg(
            F.sort_array(F.collect_list(F.struct("e", value))).alias("_w")
        )
        return grouped.select(*KEY, "split", "start", F.col(f"_w.{value}").alias("tokens"))
    wanted = (F.col("e") >= context) & ((F.col("e") - context) % stride == 0)
    full = framed(
        coded.select(*KEY, "split", "e", value), KEY, "e",
        lambda w: {"tokens": F.collect_list(value).over(w.rowsBetween(-context, 0))}, before=context,
    )
    return full.where(wanted).select(*KEY, "split", (F.col("e") - context).alias("start"), "tokens")


def locate(indices: DataFrame, counts: DataFrame, stride: int = 1, blocks: int = 1_000_000) -> DataFrame:
    """Place global window numbers (``split``, ``window_index``) in their sessions: adds key and ``start``.

    A range join made equi: a session is listed under each block of numbers it touches, with about
    ``blocks`` blocks in all whatever the number of windows.
    """
    width = counts.agg(F.greatest(F.lit(4096), F.ceil(F.max("last") / blocks)).alias("_width"))
    sized = counts.where("windows > 0").join(F.broadcast(width))
    touched = F.explode(F.sequence(F.floor(F.col("first") / F.col("_width")), F.floor((F.col("last") - 1) / F.col("_width"))))
    ranges = sized.select(*KEY, "split", "first", "last", touched.alias("_block"))
    asked = indices.join(F.broadcast(width)).withColumn("_block", F.floor(F.col("window_index") / F.col("_width"))).drop("_width")
    inside = (F.col("window_index") >= F.col("first")) & (F.col("window_index") < F.col("last"))
    placed = asked.join(ranges, ["split", "_block"]).where(inside)
    return placed.withColumn("start", (F.col("window_index") - F.col("first")) * stride).drop("first", "last", "_block")


def even_index(k: Column, n: Column, m: Column) -> Column:
    """``k``-th of ``m`` evenly spaced whole numbers from 0 to ``n - 1``, rounded down, the last one exact."""
    return F.when(m == 1, F.lit(0)).when(k == m - 1, n - 1).otherwise(F.floor(k * ((n - 1) / (m - 1)))).cast("bigint")


def evaluation_subset(totals: DataFrame, maximum: int, name: str = "window_index") -> DataFrame:
    """(``split``, ``n``) to at most ``maximum`` evenly spaced indices per split."""
    m = F.least(F.col("n"), F.lit(maximum)).cast("bigint")
    picked = totals.where("n > 0").withColumn("_m", m).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)))
    return picked.select("split", even_index(F.col("_k"), F.col("n"), F.col("_m")).alias(name))


def split_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("split").agg(F.sum("windows").alias("n"))


def sample_stream(totals: DataFrame, seeds: Sequence[int], steps: int, batch: int) -> DataFrame:
    """Uniform window numbers with replacement, fixed by (seed, step, slot) and shared by every model."""
    spark = totals.sparkSession
    slots = spark.range(steps * batch).select(
        (F.floor(F.col("id") / batch) + 1).cast("bigint").alias("step"), (F.col("id") % batch).alias("slot")
    )
    seeded = slots.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    # `totals` has at most one row per split.
    return seeded.join(F.broadcast(totals)).select(
        "split", "seed", "step", "slot", (draw(F.col("seed"), F.col("step"), F.col("slot")) % F.col("n")).alias("window_index")
    )


def nested_subsets(examples: DataFrame, ident: Sequence[str], seeds: Sequence[int], budgets: Sequence[int]) -> DataFrame:
    """(seed, ident, rank) of the first ``max(budgets)`` examples of one permutation per seed.

    Every budget takes a prefix of the same ranking. Spark keeps the best rows of each partition, so
    only ``max(budgets)`` rows per seed ever meet.
    """
    parts = []
    for seed in seeds:
        ranked = examples.select(*ident).withColumn("_draw", draw(F.lit(seed), *[F.col(c) for c in ident]))
        top = ranked.orderBy("_draw", *ident).limit(max(budgets))
        order = Window.partitionBy("seed").orderBy("_draw", *ident)
        parts.append(top.withColumn("seed", F.lit(seed).cast("bigint")).withColumn("rank", F.row_number().over(order)).drop("_draw"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expand_targets(located: DataFrame, context: int, mode: str) -> DataFrame:
    """Target positions ``e`` a window is trained on: its last event, or every event after the first."""
    if mode not in ("last", "dense"):
        raise ValueError("The mode is last or dense")
    last = F.col("start") + context
    targets = F.explode(F.sequence(F.col("start") + 1, last)) if mode == "dense" else last
    return located.withColumn("e", targets)


def coverage(located: DataFrame, context: int, batch: int, checkpoints: Sequence[int]) -> DataFrame:
    """Exposures and distinct target positions at each checkpoint step, for both kinds of targets."""
    spark = located.sparkSession
    marks = spark.createDataFrame([(int(c),) for c in sorted(set(checkpoints))], "step bigint")
    out = None
    for mode, factor in (("last", 1), ("dense", context)):
        first = expand_targets(located, context, mode).groupBy("seed", *KEY, "e").agg(F.min("step").alias("_first"))
        per_step = first.groupBy("seed", "_first").agg(F.count(F.lit(1)).alias("_n"))
        # At most one row per training step, against a handful of checkpoints.
        reached = per_step.join(F.broadcast(marks), F.col("_first") <= F.col("step"))
        part = reached.groupBy("seed", "step").agg(F.sum("_n").alias("unique_targets")).select(
            F.lit(mode).alias("supervision"), "seed", "step", (F.col("step") * batch).alias("sampled_windows"),
            (F.col("step") * batch * factor).alias("target_exposures"), "unique_targets",
        )
        out = part if out is None else out.unionByName(part)
    return out


def eligible(context: int, stride: int = 1) -> Column:
    """An event with a full context before it, on the stride."""
    return (F.col("e") >= context) & ((F.col("e") - context) % stride == 0)
