"""Clock-time tasks: as-of, interval and boundary lookups on a regular lattice.

All lookup times are whole units after the open, so trades are first folded into the cell
``(g - 1, g]`` they fall in. That aggregate is combined before the shuffle and leaves at most one row
per unit of the session however busy it is; running totals and as-of lookups then work on cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEY, CleanSpec, ClockSpec, clock_seconds
from ..functions.times import session_open_ns
from .clean import first_failure
from .ordering import exact_quantiles, framed, spread
from .tokens import bin_of

TASKS = ("T1", "T2", "T3")
REASONS = ("short_event_context", "incomplete_history", "stale_last_trade", "zero_past_volatility", "empty_future_vwap")
FEATURES = (
    "log_rate_history", "log_rate_ratio_short", "log_rate_ratio_long", "log_vol_history", "vol_ratio_long",
    "return_z_short", "return_z_long", "return_z_history", "log_mean_size_history", "last_price_vs_vwap_z",
    "trade_age", "clock_sin", "clock_cos",
)


def tag(offset: int) -> str:
    return f"m{-offset}" if offset < 0 else f"p{offset}"


def elapsed(trades: DataFrame, clean: CleanSpec) -> DataFrame:
    """Add ``x``: nanoseconds since the session's local open."""
    start = session_open_ns(F.col("date"), clock_seconds(clean.session_start), clean.timezone)
    return trades.withColumn("x", F.col("ts_ns") - start)


def trailing(trades: DataFrame, trail: int, context: int) -> DataFrame:
    """Add to each trade the value and size of the last ``trail`` trades and where its context began."""

    def columns(w):
        back = w.rowsBetween(-(trail - 1), 0)
        return {
            "trail_value": F.sum(F.col("price") * F.col("size")).over(back),
            "trail_size": F.sum("size").over(back),
            "context_x": F.lag("x", context - 1).over(w),
        }

    return framed(trades, KEY, "r", columns, before=max(trail, context) - 1)


def cells(trades: DataFrame, unit_ns: int) -> DataFrame:
    """Trades folded to the unit that ends their cell; a trade exactly on a boundary is already past."""
    cell = F.ceil(F.col("x") / unit_ns).cast("bigint")
    carried = [c for c in ("trail_value", "trail_size", "context_x") if c in trades.columns]
    return trades.groupBy(*KEY, cell.alias("g")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("size"),
        F.sum(F.col("price") * F.col("size")).alias("value"),
        F.max_by("price", "r").alias("price"),
        F.max("r").alias("r"),
        F.max("x").alias("x"),
        *[F.max_by(c, "r").alias(c) for c in carried],
    )


CARRIED = ("log_price", "price", "r", "x", "trail_value", "trail_size", "context_x")


def with_running(stacked: DataFrame) -> DataFrame:
    """Running totals and latest values over cells and probes in time order, probes after a cell of their time.

    Between cells the grid price does not move, so the squared grid returns live on cells alone. A
    probe adds nothing and so shows the totals as of its time.
    """
    order = Window.partitionBy(*KEY).orderBy("g", "probe")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("log_price") - F.last("log_price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    squared = stacked.withColumn("_sq", step * step)
    totals = {f"cum_{c}": F.sum(c).over(upto) for c in ("n", "size", "value")}
    latest = {c: F.last(c, ignorenulls=True).over(upto) for c in CARRIED if c in stacked.columns}
    rv = F.coalesce(F.sum("_sq").over(upto), F.lit(0.0))
    return squared.withColumns({**totals, "rv": rv, **latest}).drop("_sq")


def as_cells(folded: DataFrame) -> DataFrame:
    return folded.withColumns({"log_price": F.log("price"), "probe": F.lit(0)})


def running_cells(folded: DataFrame) -> DataFrame:
    """Running trade count, size, value and realised variance, as of each cell's end."""
    return with_running(as_cells(folded)).drop("probe")


def previous_tick_grid(folded: DataFrame, units: int) -> DataFrame:
    """Last price at every whole unit of the session; null before the first trade."""
    sessions = folded.select(*KEY).distinct()
    grid = sessions.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(units)).cast("array<bigint>")))
    order = Window.partitionBy(*KEY).orderBy("g")
    filled = grid.join(folded.select(*KEY, "g", "price"), [*KEY, "g"], "left")
    return filled.withColumn("price", F.last("price", ignorenulls=True).over(order))


def clock_anchors(sessions: DataFrame, spec: ClockSpec) -> DataFrame:
    """Anchors every ``step`` units from a full history to the last full future."""
    grid = F.sequence(F.lit(spec.history), F.lit(spec.session_units - spec.vwap_to), F.lit(spec.step))
    return sessions.select(*KEY, "split", F.explode(grid.cast("array<bigint>")).alias("anchor"))


def needed(spec: ClockSpec) -> dict[str, tuple[int, ...]]:
    """Which running total is looked up at which offset from the anchor."""
    h, (short, long) = -spec.history, (-width for width in spec.recent)
    return {
        "cum_n": (h, long, short, 0, spec.activity, spec.vwap_from, spec.vwap_to),
        "cum_size": (h, 0, spec.vwap_from, spec.vwap_to),
        "cum_value": (spec.vwap_from, spec.vwap_to),
        "rv": (h, long, 0, spec.volatility),
        "log_price": (h, long, short, 0),
        "r": (-spec.older_lag, 0),
        **{name: (0,) for name in ("price", "x", "trail_value", "trail_size", "context_x")},
    }


def asof_lookup(anchors: DataFrame, folded: DataFrame, wanted: dict[str, tuple[int, ...]]) -> DataFrame:
    """Running totals as of ``anchor + offset``, one column ``<name>_<offset>`` for each that is wanted.

    Cells and probes are stacked and sorted once per session, over at most its units plus its probes;
    the pivot back to anchors keeps that partitioning.
    """
    offsets = sorted({o for each in wanted.values() for o in each})
    probes = anchors.select(*KEY, "split", "anchor", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    asked = probes.withColumns({"g": F.col("anchor") + F.col("offset"), "probe": F.lit(1)})
    seen = with_running(as_cells(folded).unionByName(asked, allowMissingColumns=True)).where("probe = 1")
    wide = [F.max(F.when(F.col("offset") == o, F.col(name))).alias(f"{name}_{tag(o)}") for name, at in wanted.items() for o in at]
    return seen.groupBy(*KEY, "split", "anchor").agg(*wide)


def total(name: str, offset: int) -> Column:
    return F.coalesce(F.col(f"{name}_{tag(offset)}"), F.lit(0))


def moved(name: str, start: int, end: int) -> Column:
    return total(name, end) - total(name, start)


def anchor_steps(spec: ClockSpec, context: int) -> list[tuple[str, Column]]:
    age = F.col("anchor") - F.col("x_p0") / spec.unit_ns
    return list(
        zip(
            REASONS,
            (
                F.col("r_p0") >= context,
                (total("cum_n", -spec.history) > 0) & (moved("cum_n", -spec.history, 0) > 0),
                age <= spec.max_age,
                moved("rv", -spec.history, 0) > spec.rv_floor,
                moved("cum_n", spec.vwap_from, spec.vwap_to) > 0,
            ),
        )
    )


def clock_targets(spec: ClockSpec) -> dict[str, Column]:
    """Activity ratio, volatility ratio and volatility-scaled VWAP return of the near future."""
    rv, count = moved("rv", -spec.history, 0), moved("cum_n", -spec.history, 0)
    share = spec.volatility / spec.history
    future = moved("cum_value", spec.vwap_from, spec.vwap_to) / moved("cum_size", spec.vwap_from, spec.vwap_to)
    past = F.col("trail_value_p0") / F.col("trail_size_p0")
    return {
        "T1_target": moved("cum_n", 0, spec.activity) * (spec.history / spec.activity) / count,
        "T2_target": F.sqrt(F.greatest(F.lit(0.0), moved("rv", 0, spec.volatility)) / (share * rv)),
        "T3_target": F.log(future / past) / F.sqrt(share * rv),
    }


def clock_features(spec: ClockSpec) -> dict[str, Column]:
    """Thirteen features of the past alone, in the order of :data:`FEATURES`."""
    h, (short, long) = spec.history, spec.recent
    rv, count = moved("rv", -h, 0), moved("cum_n", -h, 0)
    rate = count / h
    floor = F.lit(1.0 / h)

    def ratio(width):
        return F.log((moved("cum_n", -width, 0) / width + floor) / (rate + floor))

    def scaled(width):
        return (F.col("log_price_p0") - F.col(f"log_price_{tag(-width)}")) / F.sqrt(rv * width / h)

    past = F.col("trail_value_p0") / F.col("trail_size_p0")
    turn = F.lit(2 * math.pi) * F.col("anchor") / spec.session_units
    share = spec.volatility / spec.history
    columns = (
        F.log1p(rate), ratio(short), ratio(long), F.log(F.sqrt(rv / h)),
        F.sqrt(F.greatest(F.lit(0.0), moved("rv", -long, 0)) / (share * rv)),
        scaled(short), scaled(long), scaled(h),
        F.log1p(moved("cum_size", -h, 0) / count),
        F.log(F.col("price_p0") / past) / F.sqrt(share * rv),
        F.col("anchor") - F.col("x_p0") / spec.unit_ns, F.sin(turn), F.cos(turn),
    )
    return dict(zip(FEATURES, columns))


def marked_anchors(
    trades: DataFrame, sessions: DataFrame, spec: ClockSpec, clean: CleanSpec, context: int
) -> DataFrame:
    """Every candidate anchor with its boundary states and the first reason to exclude it, if any."""
    followed = trailing(elapsed(trades, clean).select(*KEY, "r", "x", "price", "size"), spec.trail, context)
    looked = asof_lookup(clock_anchors(sessions, spec), cells(followed, spec.unit_ns), needed(spec))
    return looked.withColumn("first_fail", first_failure(anchor_steps(spec, context)))


def clock_examples(marked: DataFrame, spec: ClockSpec) -> DataFrame:
    """Kept anchors with identity, counts, features and targets."""
    identity = {
        "last_raw_trade_index": F.col("r_p0"),
        "last_code_index": F.col("r_p0") - 1,
        "last_trade": F.col("x_p0") / spec.unit_ns,
        "future_end": F.col("anchor") + spec.vwap_to,
        "past_trade_count": moved("cum_n", -spec.history, 0),
        "future_activity_count": moved("cum_n", 0, spec.activity),
        "future_vwap_count": moved("cum_n", spec.vwap_from, spec.vwap_to),
        "context_span": (F.col("x_p0") - F.col("context_x_p0")) / spec.unit_ns,
        "older_trade_index": F.col(f"r_{tag(-spec.older_lag)}"),
    }
    named = {**identity, **clock_features(spec), **clock_targets(spec)}
    return marked.where(F.col("first_fail").isNull()).select(
        "split", *KEY, "anchor", *[column.alias(name) for name, column in named.items()]
    )


def exclusion_counts(marked: DataFrame) -> DataFrame:
    """Candidates, kept and excluded by reason, per session: the three always add up."""
    reasons = [F.count_if(F.col("first_fail") == reason).alias(reason) for reason in REASONS]
    return marked.groupBy(*KEY, "split").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("first_fail").isNull()).alias("retained"), *reasons
    )


def fit_thresholds(examples: DataFrame) -> dict[str, tuple[float, float]]:
    """Tertiles of each target on training anchors; equal tertiles are an error."""
    train = examples.where("split = 'train'")
    found = exact_quantiles(train, {f"{task}_target": [1 / 3, 2 / 3] for task in TASKS})
    thresholds = {task: tuple(found[f"{task}_target"]) for task in TASKS}
    if any(not lo < hi for lo, hi in thresholds.values()):
        raise ValueError("Degenerate tertiles: the classes cannot be told apart")
    return thresholds


def apply_thresholds(examples: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    return examples.withColumns({f"{t}_label": bin_of(F.col(f"{t}_target"), thresholds[t]) for t in TASKS})


def long_labels(labelled: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"{t}_label").alias("label")) for t in TASKS])
    return labelled.select("split", *KEY, "anchor", F.inline(pairs))


def class_distribution(labelled: DataFrame) -> DataFrame:
    classes = [F.count_if(F.col("label") == k).alias(f"class_{k}") for k in range(3)]
    return long_labels(labelled).groupBy("task", "split", *KEY).agg(F.count(F.lit(1)).alias("n"), *classes)


def older_windows(examples: DataFrame, trades: DataFrame, spec: ClockSpec, clean: CleanSpec, context: int, event_offset: int) -> DataFrame:
    """A second, older context per anchor: ``event`` trades back, or the last trade ``older_lag`` units before.

    ``usable`` is false where too little past remains or the older window is not strictly older.
    """
    policies = F.array(
        F.struct(F.lit("event").alias("policy"), (F.col("last_raw_trade_index") - event_offset).alias("older_r")),
        F.struct(F.lit("clock").alias("policy"), F.col("older_trade_index").alias("older_r")),
    )
    points = examples.select("split", *KEY, "anchor", F.col("last_raw_trade_index").alias("current_r"), F.inline(policies))
    points = points.withColumn("usable", F.coalesce((F.col("older_r") >= context) & (F.col("older_r") < F.col("current_r")), F.lit(False)))
    ends = F.array(
        F.struct(F.lit("end").alias("role"), F.col("older_r").alias("r")),
        F.struct(F.lit("start").alias("role"), (F.col("older_r") - context + 1).alias("r")),
    )
    asked = points.select("*", F.inline(ends))
    times = elapsed(trades, clean).select(*KEY, "r", F.col("x").alias("at"))
    found = asked.join(times, [*KEY, "r"], "left")
    at = {role: F.max(F.when(F.col("role") == role, F.col("at"))) for role in ("end", "start")}
    grouped = found.groupBy("split", *KEY, "anchor", "policy", "current_r", "older_r", "usable").agg(
        at["end"].alias("older_endpoint_ns"), at["start"].alias("older_start_ns")
    )
    now = F.col("anchor") * F.lit(spec.unit_ns).cast("bigint")
    return grouped.select(
        "split", *KEY, "anchor", "policy", "current_r", "older_r", "usable", "older_endpoint_ns",
        (now - F.col("older_endpoint_ns")).alias("endpoint_age_ns"),
        (now - F.col("older_start_ns")).alias("total_span_ns"),
        F.greatest(F.lit(0), context - (F.col("current_r") - F.col("older_r"))).alias("overlap_events"),
    )


def require_older(windows: DataFrame) -> None:
    if windows.where(~F.col("usable")).limit(1).count():
        raise ValueError("An older window lacks past context or is not strictly older")


def audit_volatility(examples: DataFrame, trades: DataFrame, spec: ClockSpec, clean: CleanSpec) -> DataFrame:
    """Recompute the volatility target of each session's first, middle and last kept anchor from trades alone.

    A different route on purpose: a range join of trades to the anchors they precede, folded at once to
    each anchor's own grid. A trade meets at most three anchors, and the join goes chunk by chunk.
    """
    order = Window.partitionBy(*KEY).orderBy("anchor")
    ranked = examples.select(*KEY, "anchor", "T2_target").withColumns(
        {"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEY))}
    )
    picked = ranked.where(F.col("_i").isin(0) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
    sizes = trades.groupBy(*KEY).agg((F.max("r") + 1).alias("rows"))
    timed = elapsed(trades, clean).select(*KEY, "r", "x", "price")
    met = spread(timed, picked, KEY, "r", sizes).where(F.col("x") <= (F.col("anchor") + spec.volatility) * F.lit(spec.unit_ns).cast("bigint"))
    point = F.greatest(F.ceil(F.col("x") / spec.unit_ns), F.col("anchor") - spec.history)
    last = met.groupBy(*KEY, "anchor", "T2_target", point.alias("g")).agg(F.max_by("price", "r").alias("price"))
    steps = Window.partitionBy(*KEY, "anchor").orderBy("g")
    moved = last.withColumn("_sq", F.pow(F.log(F.col("price") / F.lag("price").over(steps)), 2))
    past = F.sum(F.when(F.col("g") <= F.col("anchor"), F.col("_sq")))
    ahead = F.coalesce(F.sum(F.when(F.col("g") > F.col("anchor"), F.col("_sq"))), F.lit(0.0))
    again = F.sqrt(ahead / (spec.volatility / spec.history * past))
    return moved.groupBy(*KEY, "anchor", "T2_target").agg(again.alias("recomputed")).withColumn(
        "error", F.abs(F.col("recomputed") - F.col("T2_target"))
    )


def example_violations(examples: DataFrame, spec: ClockSpec) -> DataFrame:
    """Anchors that see the future, leave the session, or overlap the next one; all must be zero."""
    gap = F.col("anchor") - F.lag("anchor").over(Window.partitionBy(*KEY).orderBy("anchor"))
    return examples.withColumn("_gap", gap).agg(
        F.count_if(F.col("last_trade") > F.col("anchor")).alias("future_input"),
        F.count_if(F.col("future_end") > spec.session_units).alias("past_close"),
        F.count_if(F.col("_gap") < spec.vwap_to).alias("overlapping"),
    )


def causality_check(
    trades: DataFrame, sessions: DataFrame, spec: ClockSpec, clean: CleanSpec, context: int, t0: int, factor: Column
) -> DataFrame:
    """Alter prices after unit ``t0`` and compare anchors up to ``t0``: inputs must hold, targets may move.

    ``factor`` multiplies the price of each later trade. Anchors are matched, not their exclusion, as
    only the future part of the waterfall may depend on later trades.
    """
    late = F.col("x") > F.lit(t0 * spec.unit_ns)
    timed = elapsed(trades, clean)
    changed = timed.withColumn("price", F.when(late, F.col("price") * factor).otherwise(F.col("price"))).drop("x")

    def run(source):
        return clock_examples(marked_anchors(source, sessions, spec, clean, context), spec).where(F.col("anchor") <= t0)

    before, after = run(trades), run(changed)
    inputs = changed_keys(before, after, [*KEY, "anchor"], ["split", "last_raw_trade_index", *FEATURES])
    targets = changed_keys(before, after, [*KEY, "anchor"], ["T1_target", "T2_target", "T3_target"])
    # A key comes up once for each kind in which it differs; one row of counts is left of both.
    both = inputs.select(F.lit(1).alias("of_inputs")).unionByName(targets.select(F.lit(0).alias("of_inputs")))
    return both.agg(F.count_if(F.col("of_inputs") == 1).alias("changed_inputs"), F.count_if(F.col("of_inputs") == 0).alias("changed_targets"))


def changed_keys(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], places: int = 9) -> DataFrame:
    """Keys whose rows are not the same on both sides, rows that only one side has included.

    Rows count +1 and -1, and equal ones cancel in one grouped sum. Reals are compared to ``places``, as two runs may differ in their last bits.
    """
    def signed(df: DataFrame, sign: int) -> DataFrame:
        real = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
        rounded = [(F.round(F.col(v), places) + F.lit(0.0)).alias(v) if v in real else F.col(v) for v in values]
        return df.select(*keys, *rounded, F.lit(sign).alias("_sign"))

    net = signed(before, 1).unionByName(signed(after, -1)).groupBy(*keys, *values).agg(F.sum("_sign").alias("_net"))
    return net.where("_net <> 0").select(*keys).distinct()
