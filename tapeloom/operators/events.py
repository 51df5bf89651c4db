"""Sessions and event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEY, SPLITS, SplitSpec
from .clean import calendar
from .ordering import framed, positions, running_totals, spread

FEATURES = ("f0", "f1", "f2")
BEFORE = ("g0", "g1", "g2")


def number_trades(kept: DataFrame) -> DataFrame:
    """Add ``r``, the trade's place in its session by (time, feed sequence), and the session's ``trades``."""
    return positions(kept, KEY, ["ts_ns", "seq"], "r", total="trades")


def event_features(numbered: DataFrame) -> DataFrame:
    """Interval, return and size of each trade against the one before it.

    Trade ``r`` ends event ``e = r - 1``; the first trade of a session has none and keeps nulls. The
    event before it comes along as ``g0..g2``, so that a transition needs no further shuffle.
    """

    back = {f"_{c}{k}": (c, k) for c, k in (("ts_ns", 1), ("ts_ns", 2), ("price", 1), ("price", 2), ("size", 1))}
    lagged = framed(numbered, KEY, "r", lambda w: {name: F.lag(c, k).over(w) for name, (c, k) in back.items()}, before=2)

    def features(here: tuple[str, str, str], earlier: tuple[str, str], known: Column) -> list[Column]:
        ts, price, size = (F.col(c) for c in here)
        return [
            F.when(known, F.log1p((ts - F.col(earlier[0])) / 1e9)),
            F.when(known, F.log(price / F.col(earlier[1])) * 10000),
            F.when(known, F.log1p(size)),
        ]

    now = features(("ts_ns", "price", "size"), ("_ts_ns1", "_price1"), F.col("r") > 0)
    before = features(("_ts_ns1", "_price1", "_size1"), ("_ts_ns2", "_price2"), F.col("r") > 1)
    return lagged.withColumns({**dict(zip(FEATURES, now)), **dict(zip(BEFORE, before))}).drop(*back)


def events_of(trades: DataFrame, context: int | None = None) -> DataFrame:
    """Events ``e = 0..n-1``; with ``context``, only of sessions that have more than ``context`` events."""
    events = trades.where("r > 0").select(
        "symbol", "date", "split", (F.col("r") - 1).alias("e"), (F.col("trades") - 1).alias("events"), "ts_ns", *FEATURES, *BEFORE
    )
    return events if context is None else drop_short(events, context)


def drop_short(events: DataFrame, context: int) -> DataFrame:
    return events.where(F.col("events") > context)


def short_sessions(trades: DataFrame, context: int) -> DataFrame:
    """Sessions left out because no full window fits, with their event counts."""
    return all_sessions(trades).where((F.col("events") > 0) & (F.col("events") <= context))


def all_sessions(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*KEY).agg(F.first("split").alias("split"), (F.count(F.lit(1)) - 1).alias("events"))


def session_table(trades: DataFrame, context: int) -> DataFrame:
    """Usable sessions with dense ids ``sid`` in (symbol, date) order and their order ``k`` inside the split."""
    usable = all_sessions(trades).where(F.col("events") > context).withColumn("_one", F.lit(1))
    ranked = running_by_symbol(running_by_symbol(usable, "_one", "k"), "_one", "sid", groups=())
    return ranked.select("sid", *KEY, "split", "events", "k")


def running_by_symbol(sessions: DataFrame, amount: str, name: str, groups: tuple[str, ...] = ("split",)) -> DataFrame:
    """Exclusive running sum over sessions in (symbol, date) order, within ``groups``.

    Totals per symbol come first: no window sees more than one symbol's dates or one row per symbol.
    """
    totals = sessions.groupBy(*groups, "symbol").agg(F.sum(amount).alias("_t"))
    earlier = Window.partitionBy(*groups).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*groups, "symbol", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sessions.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(base, [*groups, "symbol"])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def expected_sessions(spark, spec: SplitSpec) -> DataFrame:
    return calendar(spark, spec)


def missing_sessions(sessions: DataFrame, spec: SplitSpec) -> DataFrame:
    """Calendar sessions that the data lacks, or has too short to use."""
    return expected_sessions(sessions.sparkSession, spec).join(sessions, list(KEY), "left_anti").select(*KEY, "split")


POLICIES = ("error", "skip")


def require_sessions(sessions: DataFrame, spec: SplitSpec, policy: str = "error") -> list[str]:
    """Refuse missing sessions, or, with ``skip``, give the warning that tells of them."""
    if policy not in POLICIES:
        raise ValueError("The policy is error or skip")
    n = missing_sessions(sessions, spec).count()
    if n and policy == "error":
        raise ValueError(f"{n} expected sessions are missing or short")
    return [f"{n} expected sessions are missing or short and were skipped"] if n else []


def empty_splits(sessions: DataFrame) -> DataFrame:
    wanted = sessions.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return wanted.join(sessions, "split", "left_anti")


def check_splits(sessions: DataFrame) -> None:
    lacking = [row.split for row in empty_splits(sessions).collect()]
    if lacking:
        raise ValueError(f"Splits without a usable session: {sorted(lacking)}")


def outside_range(events: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Share of each session's events outside the training range, per field."""
    shares = [
        F.avg(F.when((F.col(f) < F.lit(lo)) | (F.col(f) > F.lit(hi)), 1.0).otherwise(0.0)).alias(f"outside_{f}")
        for f, lo, hi in zip(FEATURES, low, high)
    ]
    return events.groupBy(*KEY).agg(F.first("split").alias("split"), *shares)


def elapsed_seconds(ts_ns: Column, open_ns: Column) -> Column:
    return (ts_ns - open_ns) / 1e9


def recover_ns(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Absolute trade times from interval features and saved anchors (key, ``r``, ``anchor_ns``).

    Each anchor implies an offset of its session; ``agree`` says whether all anchors implied the same.
    """
    gaps = {"_gap": F.rint(F.expm1("f0") * 1e9).cast("bigint")}
    timed = running_totals(events.select(*KEY, "e", "f0"), KEY, "e", {"_sum": gaps["_gap"]})
    at = timed.select(*KEY, (F.col("e") + 1).alias("r"), "_sum")
    implied = anchors.join(at, [*KEY, "r"], "left").withColumn(
        "_offset", F.col("anchor_ns") - F.when(F.col("r") == 0, F.lit(0)).otherwise(F.col("_sum"))
    )
    offsets = implied.groupBy(*KEY).agg(
        F.min("_offset").alias("_low"), (F.min("_offset") == F.max("_offset")).alias("agree")
    )
    sizes = events.groupBy(*KEY).agg((F.max("e") + 2).alias("rows"))
    return spread(at, offsets, KEY, "r", sizes).select(*KEY, "r", (F.col("_sum") + F.col("_low")).alias("ts_ns"), "agree")


def require_same_offsets(recovered: DataFrame) -> None:
    if recovered.where(~F.col("agree")).limit(1).count():
        raise ValueError("Recovered times disagree with the saved anchors")


def code_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events whose codes differ between two tables, or that only one of them has."""
    codes = ("c0", "c1", "c2")
    a = left.select(*KEY, "e", F.struct(*codes).alias("left_codes"))
    b = right.select(*KEY, "e", F.struct(*codes).alias("right_codes"))
    return a.join(b, [*KEY, "e"], "full").where(~F.col("left_codes").eqNullSafe(F.col("right_codes")))


def assert_same_codes(left: DataFrame, right: DataFrame) -> None:
    n = code_differences(left, right).count()
    if n:
        raise ValueError(f"{n} events have other codes than the stored ones")
