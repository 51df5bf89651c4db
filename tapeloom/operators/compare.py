"""Comparison of methods over seeds, sessions and dates, with date-block inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw

TOLERANCE = 1e-7


def seed_summary(metrics: DataFrame, keys: Sequence[str], value: str = "nll") -> DataFrame:
    """Mean, sample deviation (null for one seed) and count over seeds."""
    return metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("seed_std"), F.count(value).alias("seeds")
    )


def only(condition: Column | None, value: Column) -> Column:
    """The one value of a group that meets ``condition`` (null if none does); a second one is an error."""
    chosen = value if condition is None else F.when(condition, value)
    repeated = F.raise_error(F.lit("A key occurs more than once where one value is expected"))
    return F.when(F.count(chosen) > 1, repeated).otherwise(F.max(chosen))


def pivot_metrics(metrics: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str = "nll") -> DataFrame:
    """One column per name; two values for one key and name are an error."""
    return metrics.groupBy(*keys).agg(*[only(F.col(column) == name, F.col(value)).alias(str(name)) for name in names])


def paired_rows(metrics: DataFrame, left: str, right: str, on: Sequence[str], value: str = "nll", column: str = "method") -> DataFrame:
    """Left minus right on matching keys: one aggregate in place of a self join."""
    sides = metrics.where(F.col(column).isin(left, right)).groupBy(*on).agg(
        only(F.col(column) == left, F.col(value)).alias("_l"), only(F.col(column) == right, F.col(value)).alias("_r")
    )
    both = sides.where(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    return both.select(*on, F.lit(f"{left} - {right}").alias("comparison"), (F.col("_l") - F.col("_r")).alias("delta"))


def all_pairs(metrics: DataFrame, pairs: Sequence[tuple[str, str]], on: Sequence[str], value: str = "nll") -> DataFrame:
    out = None
    for left, right in pairs:
        part = paired_rows(metrics, left, right, on, value)
        out = part if out is None else out.unionByName(part)
    return out


def paired_differences(metrics: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], value: str = "nll") -> DataFrame:
    return all_pairs(metrics, pairs, [*keys, "seed"], value).groupBy(*keys, "comparison").agg(
        F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"), F.count("delta").alias("seeds"), F.count_if(F.col("delta") < 0).alias("negative")
    )


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], cardinality: str, how: str = "inner") -> DataFrame:
    """Join that first proves its constrained sides unique: ``one_to_one`` or ``many_to_one``."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,)}
    if cardinality not in sides:
        raise ValueError("The cardinality is one_to_one or many_to_one")
    for side in sides[cardinality]:
        if duplicate_keys(side, on).limit(1).count():
            raise ValueError(f"Keys {list(on)} are not unique, so the join is not {cardinality}")
    return left.join(right, list(on), how)


def wins_ties(deltas: DataFrame, keys: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Wins below, and ties within, the tolerance; one column per seed."""
    per_seed = [only(F.col("seed") == s, F.col("delta")).alias(f"seed_{s}") for s in seeds]
    return deltas.groupBy(*keys).agg(
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") < -TOLERANCE).alias("wins"),
        F.count_if(F.abs("delta") <= TOLERANCE).alias("ties"),
        *per_seed,
    )


def gains(metrics: DataFrame, baseline: str, keys: Sequence[str], value: str = "nll", column: str = "method") -> DataFrame:
    """What each method saves against ``baseline`` on the same keys."""
    base = metrics.where(F.col(column) == baseline).select(*keys, F.col(value).alias("baseline"))
    others = metrics.where(F.col(column) != baseline)
    return checked_join(others, base, keys, "many_to_one").withColumn("gain", F.col("baseline") - F.col(value))


def gap_change(
    metrics: DataFrame, study: str, old: str, new: str, left: str, right: str, keys: Sequence[str], value: str = "nll"
) -> DataFrame:
    """Gap ``left - right`` in two studies side by side, and how each method moved."""
    cell = lambda s, m: only((F.col(study) == s) & (F.col("method") == m), F.col(value))
    wide = metrics.groupBy(*keys).agg(
        cell(old, left).alias("_ol"), cell(old, right).alias("_or"), cell(new, left).alias("_nl"), cell(new, right).alias("_nr")
    )
    old_gap, new_gap = F.col("_ol") - F.col("_or"), F.col("_nl") - F.col("_nr")
    return wide.select(
        *keys, old_gap.alias("old_gap"), new_gap.alias("new_gap"), F.try_divide(old_gap - new_gap, old_gap).alias("shrink"),
        (F.col("_ol") - F.col("_nl")).alias("left_improvement"), (F.col("_or") - F.col("_nr")).alias("right_improvement"),
    )


def grid_problems(results: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Cells of the full grid that are missing or occur more than once; a whole grid gives no rows.

    The grid is the product of the given settings; results are counted first, so it stays that small.
    """
    counts = results.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    grid = None
    for name, values in dims.items():
        kind = results.schema[name].dataType
        column = F.array(*[F.lit(v).cast(kind) for v in values])
        grid = results.sparkSession.range(1).select() if grid is None else grid
        grid = grid.withColumn(name, F.explode(column))
    found = grid.join(counts, list(dims), "full")
    return found.where(F.coalesce("n", F.lit(0)) != 1).withColumn("n", F.coalesce("n", F.lit(0)))


def check_grid(results: DataFrame, dims: dict[str, Sequence]) -> None:
    n = grid_problems(results, dims).count()
    if n:
        raise ValueError(f"{n} grid cells are missing or repeated")


def key_differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows, as a multiset, that only one side has."""
    a, b = left.select(*on), right.select(*on)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def check_same_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    if key_differences(left, right, on).limit(1).count():
        raise ValueError("The runs were not scored on identical rows")


def learning_curves(history: DataFrame, coverage: DataFrame) -> DataFrame:
    return checked_join(history, coverage.select("supervision", "seed", "step", "unique_targets"), ["supervision", "seed", "step"], "many_to_one")


def contrasts(wide: DataFrame, keys: Sequence[str], named: dict[str, Column]) -> DataFrame:
    """Named differences of pivoted losses in long form; a difference of differences is just a longer sum."""
    pairs = F.array(*[F.struct(F.lit(n).alias("comparison"), c.alias("delta")) for n, c in named.items()])
    return wide.select(*keys, F.inline(pairs))


def hierarchical_mean(losses: DataFrame, keys: Sequence[str], levels: Sequence[str], value: str = "nll") -> DataFrame:
    """Average the levels away one after another, so every member of a level weighs the same."""
    left = list(levels)
    current = losses.groupBy(*keys, *left).agg(F.avg(value).alias("mean"))
    while left:
        left.pop()
        current = current.groupBy(*keys, *left).agg(F.avg("mean").alias("mean"))
    return current


def by_cohort(df: DataFrame, cohorts: dict[str, Sequence[str]]) -> DataFrame:
    """Repeat rows once per cohort their symbol belongs to; cohorts may overlap."""
    rows = [(name, symbol) for name, symbols in cohorts.items() for symbol in symbols]
    membership = df.sparkSession.createDataFrame(rows, "cohort string, symbol string")
    # Membership is settings.
    return df.join(F.broadcast(membership), "symbol")


def block_bootstrap(daily: DataFrame, block: int, replicates: int, seed: int, keys: Sequence[str] = ("cohort", "comparison")) -> DataFrame:
    """Circular moving-block bootstrap over dates, with one set of drawn dates for all contrasts.

    ``daily`` holds (keys, date, delta). Gives the mean, a 95% percentile interval and the centred
    two-sided p-value. Draws are fixed by (seed, replicate, slot).
    """
    keys = list(keys)
    dates = daily.select(*keys[:-1], "date").distinct()
    order = Window.partitionBy(*keys[:-1]).orderBy("date")
    numbered = dates.withColumn("day", F.row_number().over(order) - 1)
    sizes = numbered.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("n"))
    if sizes.where("n < 5").limit(1).count():
        raise ValueError("Too few dates for block inference: at least five are needed")
    # One row per cohort, sent to the replicates; a cohort has one row per date.
    slots = daily.sparkSession.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(sizes))
    j = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1))
    starts = slots.withColumn("slot", j).withColumn("start", draw(F.lit(seed), F.col("replicate"), F.col("slot")) % F.col("n"))
    picked = (
        starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
        .where(F.col("slot") * block + F.col("step") < F.col("n"))
        .withColumn("day", ((F.col("start") + F.col("step")) % F.col("n")).cast("int"))
    )
    # How often each replicate drew each day; the contrasts then join days, so they share the draws.
    weights = picked.groupBy(*keys[:-1], "replicate", "day").agg(F.count(F.lit(1)).alias("w"))
    valued = daily.join(numbered, [*keys[:-1], "date"]).select(*keys, "day", "delta")
    draws = weights.join(valued, [*keys[:-1], "day"]).groupBy(*keys, "replicate").agg(
        (F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("mean")
    )
    theta = daily.groupBy(*keys).agg(F.avg("delta").alias("theta"), F.count(F.lit(1)).alias("dates"))
    far = F.count_if(F.abs(F.col("mean") - F.col("theta")) >= F.abs("theta"))
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return draws.join(theta, keys).groupBy(*keys, "theta", "dates").agg(bounds.alias("_b"), far.alias("_far")).select(
        *keys, F.col("theta").alias("delta"), F.col("_b")[0].alias("ci95_low"), F.col("_b")[1].alias("ci95_high"),
        ((F.col("_far") + 1) / F.lit(replicates + 1)).alias("p_two_sided"), F.lit(block).alias("block_days"), "dates",
    )


def holm(tests: DataFrame, keys: Sequence[str], p: str = "p_two_sided", name: str = "comparison") -> DataFrame:
    """Step-down adjusted p-values within ``keys``, a handful of planned comparisons each."""
    order = Window.partitionBy(*keys).orderBy(p, name)
    rest = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1
    stepped = tests.withColumn("_s", F.col(p) * rest)
    running = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("holm_p", F.least(running, F.lit(1.0))).drop("_s")


def leave_one_out(daily: DataFrame, keys: Sequence[str] = ("cohort", "comparison")) -> DataFrame:
    """Mean over the other dates for each omitted date; needs two dates."""
    whole = daily.groupBy(*keys).agg(F.sum("delta").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return daily.join(whole, list(keys)).where("_n > 1").select(
        *keys, F.col("date").alias("omitted_date"), ((F.col("_s") - F.col("delta")) / (F.col("_n") - 1)).alias("delta")
    )


def seed_contrasts(per_seed: DataFrame, keys: Sequence[str] = ("cohort", "comparison")) -> DataFrame:
    """How many seeds improve by more than the tolerance."""
    return per_seed.groupBy(*keys).agg(F.count_if(F.col("delta") < -TOLERANCE).alias("improving_seeds"), F.count(F.lit(1)).alias("seeds"))


def undeclared_gaps(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared (date, symbol) pairs without data, and per date the number of symbols seen."""
    seen = observed.select("date", "symbol").distinct()
    return declared.join(seen.withColumn("_seen", F.lit(1)), ["date", "symbol"], "left").groupBy("date").agg(
        F.count("_seen").alias("symbols"), F.count_if(F.col("_seen").isNull()).alias("missing")
    )


def check_declared(observed: DataFrame, declared: DataFrame) -> None:
    if undeclared_gaps(observed, declared).where("missing > 0").limit(1).count():
        raise ValueError("Declared sessions are missing")
