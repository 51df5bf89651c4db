"""Questions about event-time labels and clock-time tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEY
from ..operators import clock, events, labels
from ..operators.clean import waterfall_counts
from .oracle import clock as clock_sql
from .prepare import BAND, HORIZON, Prepared
from .questions import question


@question("symbol date e:i future:r seconds:r label:i", "SELECT * FROM labelled")
def future_labels(p: Prepared):
    found = labels.future_labels(p.events, HORIZON, BAND)
    return found.select(*KEY, "e", F.col("future_log_return_bps").alias("future"), F.col("horizon_seconds").alias("seconds"), "label")


@question("split example_index:i symbol date input_start:i anchor:i label_end:i label:i future:r seconds:r", "SELECT * FROM ex")
def event_examples(p: Prepared):
    return p.examples.select(
        "split", "example_index", *KEY, "input_start", "anchor", "label_end", "label",
        F.col("future_log_return_bps").alias("future"), F.col("horizon_seconds").alias("seconds"),
    )


@question("split example_index:i symbol date anchor:i", "SELECT * FROM ex")
def numbered_examples(p: Prepared):
    """The same index by ordering the examples themselves."""
    return labels.number_examples(p.examples.select("split", *KEY, "anchor")).select("split", "example_index", *KEY, "anchor")


#: A context longer than both widths, so that the 21 features all differ.
LONG = 24
HISTORY = {
    "last_f0": "f0", "last_f1": "f1", "last_f2": "f2",
    **{f"{name}_{width}": aggregate.format(f"w{LONG if width == 'context' else width}")
       for width in ("5", "20", "context")
       for name, aggregate in (
           ("return_sum", "sum(f1) OVER {0}"), ("return_std", "stddev_pop(f1) OVER {0}"), ("return_abs", "avg(abs(f1)) OVER {0}"),
           ("interval_mean", "avg(f0) OVER {0}"), ("size_mean", "avg(f2) OVER {0}"), ("size_std", "stddev_pop(f2) OVER {0}"))},
}
HISTORY_SQL = ", ".join(f"CAST(CAST({sql} AS FLOAT) AS DOUBLE) AS {name}" for name, sql in HISTORY.items())
HISTORY_WINDOWS = ", ".join(f"w{n} AS (PARTITION BY symbol, date ORDER BY e ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20, LONG))


@question(
    "symbol date anchor:i " + " ".join(f"{name}:r" for name in HISTORY),
    f"""SELECT * FROM (SELECT symbol, date, e AS anchor, events, {HISTORY_SQL} FROM all_ev WHERE events > {LONG} WINDOW {HISTORY_WINDOWS})
        WHERE anchor >= {LONG - 1} AND (anchor - {LONG - 1}) % {LONG + HORIZON} = 0 AND anchor + {HORIZON} < events""",
)
def history_features(p: Prepared):
    """All 21 features, over 5, 20 and 24 events."""
    found = labels.event_examples(events.events_of(p.trades, LONG), LONG, HORIZON, BAND)
    return found.select(*KEY, "anchor", *[F.col(name).cast("double") for name in HISTORY])


@question(
    "split example_index:i symbol date anchor:i",
    """SELECT * FROM ex WHERE split = 'train' OR (split, example_index) IN (
         SELECT split, CASE WHEN m = 1 THEN 0 WHEN k = m - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / (m - 1))) AS BIGINT) END
         FROM (SELECT split, count(*) AS n, least(count(*), 20) AS m FROM ex WHERE split <> 'train' GROUP BY 1), LATERAL (SELECT unnest(range(m)) AS k))""",
)
def capped_examples(p: Prepared):
    totals = labels.example_totals(p.sessions, p.context, HORIZON)
    return labels.cap_examples(p.examples, totals, 20).select("split", "example_index", *KEY, "anchor")


@question("symbol date anchor:i tokens", "SELECT h.symbol, h.date, h.e AS anchor, h.tokens FROM history h JOIN ex ON ex.symbol = h.symbol AND ex.date = h.date AND ex.anchor = h.e")
def context_codes(p: Prepared):
    found = labels.event_examples(p.coded, p.context, HORIZON, BAND, tokens="token")
    return found.select(*KEY, "anchor", F.array_join("tokens", ",").alias("tokens"))


@question("symbol date split anchor:i", "SELECT * FROM anchor", clock=True)
def clock_anchors(p: Prepared):
    return clock.clock_anchors(p.sessions, p.clock_spec)


def whole_ns(p: Prepared, name: str):
    """A time in units as whole nanoseconds, which compare exactly."""
    return F.round(F.col(name) * p.clock_spec.unit_ns).cast("bigint").alias(f"{name}_ns")


def folded(p: Prepared) -> DataFrame:
    timed = clock.elapsed(p.usable_trades, p.clean_spec)
    return clock.cells(timed, p.clock_spec.unit_ns)


@question(
    "symbol date g:i price:r",
    """SELECT g.symbol, g.date, g.g, c.price FROM (SELECT symbol, date, unnest(range(1151)) AS g FROM sess) g
       ASOF LEFT JOIN cell c ON g.symbol = c.symbol AND g.date = c.date AND g.g >= c.g""",
    clock=True,
)
def previous_tick_grid(p: Prepared):
    return clock.previous_tick_grid(folded(p), p.clock_spec.session_units)


@question("symbol date g:i cum_n:i cum_size:r cum_value:r rv:r", "SELECT * FROM cellrv", clock=True)
def running_cells(p: Prepared):
    """Running trades, size, value and realised variance at every unit that ends with a trade in it."""
    return clock.running_cells(folded(p)).select(*KEY, "g", "cum_n", "cum_size", "cum_value", "rv")


@question(
    "symbol date anchor:i n_m300:i n_m30:i n_m5:i n0:i n10:i n25:i n35:i s0:r v35:r rv_m300:r rv0:r rv30:r r0:i r_m20:i",
    "SELECT * FROM wide",
    clock=True,
)
def boundary_lookup(p: Prepared):
    """Running totals as of every boundary around each candidate anchor."""
    named = {
        "n_m300": "cum_n_m300", "n_m30": "cum_n_m30", "n_m5": "cum_n_m5", "n0": "cum_n_p0", "n10": "cum_n_p10", "n25": "cum_n_p25",
        "n35": "cum_n_p35", "s0": "cum_size_p0", "v35": "cum_value_p35", "rv_m300": "rv_m300", "rv0": "rv_p0", "rv30": "rv_p30",
    }
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in named.items()]
    return p.anchors.select(*KEY, "anchor", *filled, F.col("r_p0").alias("r0"), F.col("r_m20").alias("r_m20"))


@question(
    "symbol date anchor:i past_count:i activity_count:i log_past_vwap:r log_future_vwap:r",
    """SELECT symbol, date, anchor, n0 - n_m300 AS past_count, n10 - n0 AS activity_count, ln(tv0 / ts0) AS log_past_vwap,
         CASE WHEN s35 > s25 THEN ln((v35 - v25) / (s35 - s25)) END AS log_future_vwap FROM amark WHERE r0 >= 12""",
    clock=True,
)
def interval_vwaps(p: Prepared):
    """Counts over half-open intervals, trailing VWAP of ten trades and VWAP of the forward interval."""
    moved = clock.moved
    size = moved("cum_size", 25, 35)
    return p.anchors.where("r_p0 >= 12").select(
        *KEY, "anchor", moved("cum_n", -300, 0).alias("past_count"), moved("cum_n", 0, 10).alias("activity_count"),
        F.log(F.col("trail_value_p0") / F.col("trail_size_p0")).alias("log_past_vwap"), F.when(size > 0, F.log(moved("cum_value", 25, 35) / size)).alias("log_future_vwap"),
    )


@question("split symbol date anchor:i T1_target:r T2_target:r T3_target:r", "SELECT * FROM cex", clock=True)
def clock_targets(p: Prepared):
    return p.clock_examples.select("split", *KEY, "anchor", "T1_target", "T2_target", "T3_target")


@question(
    "symbol date anchor:i trade_age_ns:i " + " ".join(f"{f}:r" for f in clock.FEATURES if f != "trade_age"),
    "SELECT *, round(trade_age * 72e9) AS trade_age_ns FROM cex",
    clock=True,
)
def clock_features(p: Prepared):
    age = whole_ns(p, "trade_age")
    return p.clock_examples.select(*KEY, "anchor", age, *[f for f in clock.FEATURES if f != "trade_age"])


@question(
    "reason n:i",
    """SELECT r.reason, count(a.anchor) AS n FROM (SELECT unnest(['input', 'short_event_context', 'incomplete_history', 'stale_last_trade', 'zero_past_volatility',
       'empty_future_vwap', 'retained']) AS reason) r LEFT JOIN amark a ON r.reason = 'input' OR coalesce(a.first_fail, 'retained') = r.reason GROUP BY 1""",
    clock=True,
)
def anchor_waterfall(p: Prepared):
    return waterfall_counts(p.anchors, clock.REASONS).withColumnRenamed("step", "reason")


@question(
    "split symbol date anchor:i last_raw_trade_index:i last_code_index:i last_trade_ns:i future_end:i past_trade_count:i future_activity_count:i future_vwap_count:i context_span_ns:i",
    "SELECT *, round(last_trade * 72e9) AS last_trade_ns, round(context_span * 72e9) AS context_span_ns FROM cex",
    clock=True,
)
def clock_examples(p: Prepared):
    return p.clock_examples.select(
        "split", *KEY, "anchor", "last_raw_trade_index", "last_code_index", whole_ns(p, "last_trade"), "future_end", "past_trade_count",
        "future_activity_count", "future_vwap_count", whole_ns(p, "context_span"),
    )


@question(
    "symbol date anchor:i tokens",
    "SELECT c.symbol, c.date, c.anchor, h.tokens FROM cex c JOIN history h ON c.symbol = h.symbol AND c.date = h.date AND h.e = c.last_code_index",
    clock=True,
)
def clock_context_codes(p: Prepared):
    """Codes of the context that ends with the last trade at the anchor."""
    found = labels.context_codes(p.clock_examples, p.coded, p.context, last="last_code_index")
    return found.select(*KEY, "anchor", F.array_join("tokens", ",").alias("tokens"))


@question(
    "task low:r high:r",
    "SELECT 'T1' AS task, q1[1] AS low, q1[2] AS high FROM thr UNION ALL SELECT 'T2', q2[1], q2[2] FROM thr UNION ALL SELECT 'T3', q3[1], q3[2] FROM thr",
    clock=True,
)
def tertile_thresholds(p: Prepared):
    return p.spark.createDataFrame([(t, float(lo), float(hi)) for t, (lo, hi) in p.thresholds.items()], "task string, low double, high double")


@question("split symbol date anchor:i task label:i", "SELECT * FROM clong", clock=True)
def clock_labels(p: Prepared):
    return clock.long_labels(p.clock_labels)


DISTRIBUTION_SQL = """SELECT task, split, symbol, date, count(*) AS n, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1,
  count(*) FILTER (label = 2) AS class_2 FROM clong GROUP BY 1, 2, 3, 4"""


@question("task split symbol date n:i class_0:i class_1:i class_2:i", DISTRIBUTION_SQL, clock=True)
def class_distribution(p: Prepared):
    return clock.class_distribution(p.clock_labels)


AUDIT_SQL = (
    "SELECT symbol, date, split, count(*) AS candidates, count(*) FILTER (first_fail IS NULL) AS retained, "
    + ", ".join(f"count(*) FILTER (first_fail = '{r}') AS {r}" for r in clock.REASONS)
    + " FROM amark GROUP BY 1, 2, 3"
)


@question("symbol date split candidates:i retained:i " + " ".join(f"{r}:i" for r in clock.REASONS), AUDIT_SQL, clock=True)
def session_audit(p: Prepared):
    return clock.exclusion_counts(p.anchors)


OLDER_SQL = """SELECT o.split, o.symbol, o.date, o.anchor, o.policy, o.current_r, o.older_r, coalesce(o.older_r >= 12 AND o.older_r < o.current_r, false) AS usable,
    e.x AS older_endpoint_ns, o.anchor * 72000000000 - e.x AS endpoint_age_ns, o.anchor * 72000000000 - s.x AS total_span_ns, greatest(0, 12 - (o.current_r - o.older_r)) AS overlap_events
  FROM (SELECT split, symbol, date, anchor, 'event' AS policy, last_raw_trade_index AS current_r, last_raw_trade_index - 12 AS older_r FROM cex
        UNION ALL SELECT split, symbol, date, anchor, 'clock', last_raw_trade_index, older_trade_index FROM cex) o
  LEFT JOIN ct e ON e.symbol = o.symbol AND e.date = o.date AND e.r = o.older_r
  LEFT JOIN ct s ON s.symbol = o.symbol AND s.date = o.date AND s.r = o.older_r - 11"""


@question(
    "split symbol date anchor:i policy current_r:i older_r:i usable older_endpoint_ns:i endpoint_age_ns:i total_span_ns:i overlap_events:i", OLDER_SQL, clock=True
)
def older_windows(p: Prepared):
    return clock.older_windows(p.clock_examples, p.usable_trades, p.clock_spec, p.clean_spec, p.context, p.context)


@question(
    "symbol date anchor:i T2_target:r recomputed:r error:r",
    """SELECT symbol, date, anchor, T2_target, T2_target AS recomputed, 0.0 AS error FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY anchor) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS n FROM cex)
       WHERE i = 0 OR i = n // 2 OR i = n - 1""",
    clock=True,
)
def volatility_audit(p: Prepared):
    return clock.audit_volatility(p.clock_examples, p.usable_trades, p.clock_spec, p.clean_spec)


@question("future_input:i past_close:i overlapping:i", "SELECT 0 AS future_input, 0 AS past_close, 0 AS overlapping FROM (SELECT count(*) FROM cex)", clock=True)
def example_violations(p: Prepared):
    return clock.example_violations(p.clock_examples, p.clock_spec)


def _late_prices() -> str:
    late = "ts_ns - epoch_us(CAST(date AS TIMESTAMP)) * 1000 > 600 * 72000000000"
    factor = "1 + (r % 3) * 0.01"
    return f"SELECT symbol, date, split, r, ts_ns, CASE WHEN {late} THEN price * ({factor}) ELSE price END AS price, size FROM trades WHERE trades - 1 > 12"


@question(
    "changed_inputs:i changed_targets:i",
    """SELECT 0 AS changed_inputs, (SELECT count(*) FROM (SELECT symbol, date, anchor FROM (SELECT * FROM
           (SELECT symbol, date, anchor, round(T1_target, 9), round(T2_target, 9), round(T3_target, 9) FROM cex WHERE anchor <= 600
            EXCEPT ALL SELECT symbol, date, anchor, round(T1_target, 9), round(T2_target, 9), round(T3_target, 9) FROM cex_late WHERE anchor <= 600)
         UNION ALL SELECT * FROM (SELECT symbol, date, anchor, round(T1_target, 9), round(T2_target, 9), round(T3_target, 9) FROM cex_late WHERE anchor <= 600
            EXCEPT ALL SELECT symbol, date, anchor, round(T1_target, 9), round(T2_target, 9), round(T3_target, 9) FROM cex WHERE anchor <= 600)) GROUP BY 1, 2, 3)) AS changed_targets""",
    clock_sql("_late", _late_prices()),
    clock=True,
)
def causality_check(p: Prepared):
    """Later prices altered: no input of an earlier anchor moves, and targets that look past the change do."""
    factor = F.lit(1) + (F.col("r") % 3) * 0.01
    return clock.causality_check(p.usable_trades, p.sessions, p.clock_spec, p.clean_spec, p.context, 600, factor)
