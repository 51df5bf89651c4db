"""Frequency and first-order Markov models over tokens, kept sparse.

Counts hold at most vocab x vocab rows whatever the data size, so scoring joins them to the data;
nothing is densified and no session is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import joint_decode
from .tokens import Binner, decode_bins
from .windows import eligible

# A broadcast is used only where vocab bounds the table to about this many rows.
BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is known to be at most ``rows``, if that is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fit_frequency(train: DataFrame, vocab: int, context: int, stride: int = 1, smoothing: float = 1.0) -> DataFrame:
    """Smoothed marginal over all tokens from the eligible training targets."""
    return smoothed(train.where(eligible(context, stride)).groupBy("token").agg(F.count(F.lit(1)).alias("n")), vocab, smoothing)


def smoothed(counts: DataFrame, vocab: int, smoothing: float = 1.0) -> DataFrame:
    tokens = counts.sparkSession.range(vocab).select(F.col("id").cast("int").alias("token"))
    full = tokens.join(bounded(counts, vocab), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = full.agg(F.sum("n").alias("_total"))
    return full.join(F.broadcast(total)).select(
        "token", "n", ((F.col("n") + smoothing) / (F.col("_total") + smoothing * vocab)).alias("p")
    )


def transition_counts(coded: DataFrame, context: int, stride: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of (prev, next) within sessions. Rows carry their previous token, so this is one partial aggregate."""
    pairs = coded.where(eligible(context, stride) & F.col("prev").isNotNull())
    return pairs.groupBy(*keys, "prev", F.col("token").alias("next")).agg(F.count(F.lit(1)).alias("n"))


def sampled_transitions(targets: DataFrame, coded: DataFrame, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """Transitions of a sampled target stream, each exposure counted: the stream is folded before it is joined."""
    exposures = targets.groupBy(*keys, "symbol", "date", "e").agg(F.count(F.lit(1)).alias("_w"))
    joined = exposures.join(coded.select("symbol", "date", "e", "prev", F.col("token").alias("next")), ["symbol", "date", "e"])
    return joined.groupBy(*keys, "prev", "next").agg(F.sum("_w").alias("n"))


def matched_prior(counts: DataFrame, vocab: int, keys: Sequence[str] = ()) -> DataFrame:
    """Column sums plus one, normalised: the prior of the same exposures, per ``keys``."""
    sums = counts.groupBy(*keys, F.col("next").alias("token")).agg(F.sum("n").alias("n"))
    if not keys:
        return smoothed(sums, vocab)
    grid = counts.select(*keys).distinct().withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(vocab - 1))))
    full = grid.join(sums, [*keys, "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = Window.partitionBy(*keys)
    return full.withColumn("p", (F.col("n") + 1) / (F.sum("n").over(total) + vocab))


def check_prior(prior: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-9) -> None:
    """Each prior (one for each combination of ``keys``) is positive and sums to one; an empty table is no prior."""
    each = prior.groupBy(*keys).agg(F.min("p").alias("low"), F.sum("p").alias("total"), F.count_if(F.col("p").isNull()).alias("lacking"))
    fair = F.coalesce((F.col("low") > 0) & (F.abs(F.col("total") - 1) <= tolerance) & (F.col("lacking") == 0), F.lit(False))
    row = each.agg(F.count(F.lit(1)).alias("priors"), F.count_if(~fair).alias("unfit")).first()
    if not row.priors or row.unfit:
        raise ValueError("A prior must be positive and sum to one")


def check_strength(*strengths: float) -> None:
    if not strengths or not all(math.isfinite(s) and s > 0 for s in strengths):
        raise ValueError("Shrinkage strengths must be positive and finite")


def shrunk(n: Column, total: Column, prior: Column, strength) -> Column:
    """``(n + s * prior) / (total + s)``; a row never seen falls back to the prior."""
    s = F.lit(float(strength)) if isinstance(strength, (int, float)) else strength
    zero = F.lit(0)
    return (F.coalesce(n, zero) + s * prior) / (F.coalesce(total, zero) + s)


def with_counts(pairs: DataFrame, counts: DataFrame, prior: DataFrame, vocab: int, keys: Sequence[str] = ()) -> DataFrame:
    """Attach to each (prev, next) its count, its row's total and the prior of ``next``; a prior that is not positive is an error.

    Without ``keys`` the tables have at most vocab² rows and may be sent to all tasks; with them adaptive execution looks at sizes.
    """
    fits = (lambda df, rows: df) if keys else bounded
    totals = counts.groupBy(*keys, "prev").agg(F.sum("n").alias("row_n"))
    marginal = prior.select(*keys, F.col("token").alias("next"), F.when(F.col("p") > 0, F.col("p")).otherwise(F.raise_error(F.lit("A prior must be positive"))).alias("prior_p"))
    return (
        pairs.join(fits(counts.select(*keys, "prev", "next", "n"), vocab**2), [*keys, "prev", "next"], "left")
        .join(fits(totals, vocab), [*keys, "prev"], "left")
        .join(fits(marginal, vocab), [*keys, "next"])
    )


def shrinkage_prob(
    pairs: DataFrame, counts: DataFrame, prior: DataFrame, strength: float, vocab: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``p``, the shrunk probability of ``next`` after ``prev``. An unfit prior or strength is refused."""
    check_strength(strength)
    check_prior(prior, keys)
    joined = with_counts(pairs, counts, prior, vocab, keys)
    return joined.withColumn("p", shrunk(F.col("n"), F.col("row_n"), F.col("prior_p"), strength)).drop("n", "row_n", "prior_p")


def fold_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identical (keys, prev, next) folded into one row with weight ``w``: bounded by vocab, free of skew."""
    return pairs.groupBy(*keys, "prev", "next").agg(F.count(F.lit(1)).alias("w"))


def strength_scores(
    pairs: DataFrame, counts: DataFrame, prior: DataFrame, grid: Sequence[float], vocab: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean loss of the validation ``pairs`` for every strength of the grid. An unfit prior or strength is refused."""
    check_strength(*grid)
    check_prior(prior, keys)
    joined = with_counts(fold_pairs(pairs, keys), counts, prior, vocab, keys)
    each = joined.withColumn("strength", F.explode(F.array(*[F.lit(float(s)) for s in grid])))
    loss = -F.log(shrunk(F.col("n"), F.col("row_n"), F.col("prior_p"), F.col("strength")))
    return each.groupBy(*keys, "strength").agg((F.sum(loss * F.col("w")) / F.sum("w")).alias("nll"))


def select_strength(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lowest validation loss; equal losses go to the smaller strength."""
    best = F.min(F.struct("nll", "strength"))
    chosen = scores.groupBy(*keys).agg(best.alias("_b")) if keys else scores.agg(best.alias("_b"))
    return chosen.select(*keys, F.col("_b.strength").alias("strength"), F.col("_b.nll").alias("nll"))


def frequency_nll(pairs: DataFrame, prior: DataFrame, vocab: int) -> DataFrame:
    marginal = prior.select(F.col("token").alias("next"), F.col("p"))
    return pairs.join(bounded(marginal, vocab), "next").withColumn("nll", -F.log("p")).drop("p")


def markov_nll(pairs: DataFrame, counts: DataFrame, prior: DataFrame, strength: float, vocab: int) -> DataFrame:
    return shrinkage_prob(pairs, counts, prior, strength, vocab).withColumn("nll", -F.log("p")).drop("p")


def evaluation_pairs(located: DataFrame, coded: DataFrame, context: int) -> DataFrame:
    """(split, window_index, key, e, prev, next) for each located window's target."""
    targets = located.withColumn("e", F.col("start") + context).drop("start")
    return targets.join(coded.select("symbol", "date", "e", "prev", F.col("token").alias("next")), ["symbol", "date", "e"])


def field_nll(pairs: DataFrame, counts: DataFrame, prior: DataFrame, strength: float, bins: int) -> DataFrame:
    """Loss of interval, then price given interval, then size given both; they add up to the joint loss.

    Shrinkage is linear, so a marginal of the shrunk row is the shrunk marginal of the counts.
    """
    check_strength(strength)
    vocab = bins**3
    first, second = F.floor(F.col("next") / (bins * bins)), F.floor(F.col("next") / bins)
    pairs = pairs.withColumn("_d", first).withColumn("_dp", second)
    scored = with_counts(pairs, counts, prior, vocab).withColumn("_joint", shrunk(F.col("n"), F.col("row_n"), F.col("prior_p"), strength))
    for level, bound in (("_d", bins), ("_dp", bins**2)):
        expr = first if level == "_d" else second
        grouped = counts.groupBy("prev", expr.alias(level)).agg(F.sum("n").alias(f"_n{level}"))
        mass = prior.withColumn("next", F.col("token")).groupBy(expr.alias(level)).agg(F.sum("p").alias(f"_p{level}"))
        scored = (
            scored.join(bounded(grouped, vocab * bound), ["prev", level], "left")
            .join(bounded(mass, bound), level)
            .withColumn(f"_q{level}", shrunk(F.col(f"_n{level}"), F.col("row_n"), F.col(f"_p{level}"), strength))
        )
    return scored.select(
        *[c for c in pairs.columns if c not in ("_d", "_dp")],
        (-F.log("_q_d")).alias("interval_nll"),
        (F.log("_q_d") - F.log("_q_dp")).alias("price_nll"),
        (F.log("_q_dp") - F.log("_joint")).alias("size_nll"),
        (-F.log("_joint")).alias("nll"),
    )


def field_nll_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean field loss per ``keys`` in long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_nll").alias("nll")) for f in ("interval", "price", "size")])
    return scored.select(*keys, F.inline(pairs)).groupBy(*keys, "field").agg(F.avg("nll").alias("nll"), F.count(F.lit(1)).alias("events"))


def top_next(counts: DataFrame, prior: DataFrame, strength: float, binner: Binner, k: int) -> DataFrame:
    """The ``k`` likeliest next events after each seen token, with their typical seconds, return and size.

    Unseen successors rank by the prior alone, so the best ``k`` of a row are among its seen
    successors and the prior's best ``k`` tokens that it has not seen: those are among its best
    ``k`` and as many as the row has seen.
    """
    check_strength(strength)
    bins, vocab = binner.bins, binner.bins**3
    totals = counts.groupBy("prev").agg(F.sum("n").alias("row_n"))
    marginal = bounded(prior.select(F.col("token").alias("next"), F.col("p").alias("prior_p")), vocab)
    seen = counts.select("prev", "next", "n").join(bounded(totals, vocab), "prev")
    per_row = seen.groupBy("prev").agg(F.first("row_n").alias("row_n"), F.collect_set("next").alias("_seen"))
    # A row has at most vocab successors and the candidates are the whole vocabulary, both fixed by the bins.
    ranked = prior.agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("q"), F.col("token").alias("next")))).alias("_all"))
    unseen = per_row.join(F.broadcast(ranked)).select(
        "prev", "row_n",
        F.explode(F.slice(F.array_except(F.slice(F.col("_all.next"), F.lit(1), F.size("_seen") + k), F.col("_seen")), 1, k)).alias("next"),
    )
    both = seen.unionByName(unseen.withColumn("n", F.lit(0).cast("bigint"))).join(marginal, "next")
    scored = both.withColumn("p", shrunk(F.col("n"), F.col("row_n"), F.col("prior_p"), strength))
    best = Window.partitionBy("prev").orderBy(F.desc("p"), "next")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    decoded = top.withColumns(dict(zip(("c0", "c1", "c2"), joint_decode(F.col("next"), bins))))
    return decode_bins(decoded, binner).select("prev", "rank", "next", "p", "seconds", "return_bps", "size")
