"""Cleaning of raw prints with an exact account of every dropped row."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPLITS, CleanSpec, SplitSpec, clock_seconds
from ..functions.columns import positive, quality_code, symbol_of, to_number
from ..functions.times import (
    NANOS,
    UTC_NAMES,
    fraction_nanos,
    in_range,
    iso_parts,
    part,
    wall_seconds,
    with_local,
    with_utc,
    zone_seconds,
)

TIES_WARNING = "Equal timestamps keep the order of the feed sequence; this is no claim about causal order"
#: Columns of the readers that, in this order, tell where a row was in the input.
PROVENANCE = ("source_place", "source_file", "source_block", "source_row")
COPIES_WARNING = "Identical prints are kept: without trade ids they may be separate executions"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names; two columns that differ only by case are an error."""
    lower = [name.lower() for name in df.columns]
    twice = sorted({name for name in lower if lower.count(name) > 1})
    if twice:
        raise ValueError(f"Columns differ only by case: {twice}")
    return df.toDF(*lower)


def check_columns(df: DataFrame, spec: CleanSpec) -> list[str]:
    """Required columns are present; returns the warnings of tolerated gaps."""
    have = set(df.columns)
    symbol = spec.symbol_column in have or spec.root_column in have
    missing = [c for c in (spec.price_column, spec.size_column) if c not in have]
    if not symbol:
        missing.append(spec.symbol_column)
    if spec.timestamp_column not in have:
        missing += [c for c in (spec.date_column, spec.time_column) if c not in have]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    warnings = []
    for label, column in (("correction", spec.correction_column), ("condition", spec.condition_column)):
        if column not in have:
            if spec.require_quality_fields:
                raise ValueError(f"Missing {column}: the {label} filter needs it")
            warnings.append(f"{label} filter skipped: {column} missing")
    return warnings


def check_timestamp_type(df: DataFrame, spec: CleanSpec) -> None:
    """A number has no stated epoch or unit, so it is refused."""
    if spec.timestamp_column in df.columns and isinstance(df.schema[spec.timestamp_column].dataType, T.NumericType):
        raise ValueError("A numeric timestamp is ambiguous; give ISO text, or a date and a time column")


def with_time_parts(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Add ``_clock``, ``_fraction`` and ``_zone`` texts, from one timestamp column or from date and time."""
    if spec.timestamp_column in df.columns:
        text = F.trim(F.col(spec.timestamp_column).cast("string"))
    else:
        text = F.concat_ws(" ", F.trim(F.col(spec.date_column).cast("string")), F.trim(F.col(spec.time_column).cast("string")))
    return (
        df.withColumn("_text", text)
        .withColumn("_parts", iso_parts(F.col("_text")))
        .withColumn("_parts", F.when(F.col("_parts") != F.col("_text"), F.col("_parts")))
        .withColumns({name: part(F.col("_parts"), i) for i, name in enumerate(("_clock", "_fraction", "_zone"), 1)})
        .drop("_text", "_parts")
    )


def zone_mix(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """One row: whether zoned and naive times occur. Both at once cannot be read on one clock."""
    parts = with_time_parts(df, spec).where(F.col("_clock").isNotNull())
    return parts.agg(F.bool_or(F.col("_zone") != "").alias("zoned"), F.bool_or(F.col("_zone") == "").alias("naive"))


def check_zone_mix(df: DataFrame, spec: CleanSpec) -> None:
    refuse_mix(zone_mix(df, spec).first().asDict())


def refuse_mix(seen: dict) -> None:
    if seen.get("zoned") and seen.get("naive"):
        raise ValueError("Timestamps with and without a zone are mixed; bring the input to one zone first")


def watched(marked: DataFrame) -> tuple[DataFrame, Observation]:
    """``marked``, which tells the kinds of its times to whoever writes it: no pass of its own."""
    kinds = Observation()
    return marked.observe(kinds, *kinds_of_times()), kinds


def kinds_of_times() -> list[Column]:
    return [F.bool_or("zoned").alias("zoned"), F.bool_or(~F.col("zoned")).alias("naive")]


def parse_timestamps(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Add ``ts_ns`` (UTC), ``date``, ``clock`` (whole local seconds of the day) and ``zoned``; bad times are null.

    Each step is a column of its own, so that Spark evaluates the text work once per row.
    """
    wall, zone, utc, local = (F.col(c) for c in ("_wall", "_zone", "_utc", "_local"))
    zoned = zone != ""
    df = with_time_parts(df, spec).withColumn("_wall", wall_seconds(F.col("_clock"))).withColumn("_wall", in_range(wall))
    if spec.timezone in UTC_NAMES:
        df = df.withColumn("_utc", F.when(zoned, wall - zone_seconds(zone)).otherwise(wall)).withColumn("_local", utc)
    else:
        df = with_utc(df, "_wall", spec.timezone, "_utc").withColumn("_utc", F.when(zoned, wall - zone_seconds(zone)).otherwise(utc))
        df = with_local(df, "_utc", spec.timezone, "_local")
    return (
        df.withColumn("ts_ns", utc * NANOS + fraction_nanos(F.col("_fraction")))
        .withColumn("zoned", F.when(F.col("_clock").isNotNull(), zoned))
        .withColumn("clock", F.pmod(local, F.lit(86400)).cast("int"))
        .withColumn("date", F.date_from_unix_date(((local - F.col("clock")) / 86400).cast("int")))
        .drop("_clock", "_fraction", "_wall", "_zone", "_utc", "_local")
    )


def first_failure(steps: Sequence[tuple[str, Column]]) -> Column:
    """Label of the first predicate a row fails, null for a kept row; an unknown predicate counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(label)) for label, test in steps])


def waterfall_counts(marked: DataFrame, steps: Sequence[str], label: str = "first_fail") -> DataFrame:
    """Rows charged to each step, with zeros, plus ``input`` and ``retained``."""
    counts = marked.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    wanted = [F.sum(F.when(F.col(label) == step, F.col("n"))).alias(step) for step in steps]
    row = counts.agg(F.sum("n").alias("input"), *wanted, F.sum(F.when(F.col(label).isNull(), F.col("n"))).alias("retained"))
    names = ["input", *steps, "retained"]
    pairs = F.array(*[F.struct(F.lit(n).alias("step"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names])
    return row.select(F.inline(pairs))


def calendar(spark: SparkSession, spec: SplitSpec) -> DataFrame:
    """Every session that is expected. Symbols go to the tasks, which pair each with its dates: no product is made on the driver."""
    def days(*splits: str) -> Column:
        pairs = [(day, split if len(splits) > 1 else "heldout") for split in splits for day in getattr(spec, split)]
        rows = [F.struct(F.lit(day).cast("date").alias("date"), F.lit(split).alias("split")) for day, split in pairs]
        return F.array(*rows).cast("array<struct<date:date,split:string>>")

    symbols = spark.createDataFrame(spec.symbols(), "symbol string, held boolean")
    return symbols.select("symbol", F.inline(F.when(F.col("held"), days("test")).otherwise(days(*SPLITS[:3]))))


def split_of(symbol: Column, date: Column, spec: SplitSpec) -> Column:
    """The split of a session, null outside the calendar: one lookup of the symbol and one of the date, each in a set of settings."""
    on = lambda days: date.isin(*[datetime.date.fromisoformat(day) for day in days])
    by_date = F.coalesce(*[F.when(on(getattr(spec, split)), F.lit(split)) for split in SPLITS[:3]])
    return F.when(symbol.isin(*spec.seen), by_date).when(symbol.isin(*spec.heldout) & on(spec.test), F.lit("heldout"))


def assign_split(df: DataFrame, spec: SplitSpec) -> DataFrame:
    return df.withColumn("split", split_of(F.col("symbol"), F.col("date"), spec))


def filter_steps(spec: CleanSpec, has_correction: bool = True, has_condition: bool = True) -> list[tuple[str, Column]]:
    start, end = clock_seconds(spec.session_start), clock_seconds(spec.session_end)
    steps = [
        ("invalid_timestamp", F.col("ts_ns").isNotNull()),
        ("invalid_price_or_size", positive(F.col("price")) & positive(F.col("size"))),
    ]
    if has_correction:
        steps.append(("excluded_correction", F.col("correction").isin(*spec.allowed_corrections)))
    if has_condition:
        steps.append(("excluded_condition", F.col("condition").isin(*spec.allowed_conditions)))
    return steps + [
        ("outside_session", (F.col("clock") >= start) & (F.col("clock") < end)),
        ("outside_fixed_split", F.col("split").isNotNull()),
    ]


def input_order(have: set[str], spec: CleanSpec) -> Column:
    """What orders equal times: the feed's sequence; else the row's place in the files it was read from; else its place in the scan."""
    if spec.seq_column in have:
        return F.col(spec.seq_column).cast("bigint")
    if have.issuperset(PROVENANCE):
        return F.struct(*PROVENANCE)
    return F.monotonically_increasing_id()


def annotate(raw: DataFrame, spec: CleanSpec, split: SplitSpec) -> DataFrame:
    """Row-wise cleaning: every raw print with its parsed fields and ``first_fail``. No shuffle."""
    raw = normalize_columns(raw)
    check_columns(raw, spec)
    check_timestamp_type(raw, spec)
    text = {f.name for f in raw.schema if isinstance(f.dataType, T.StringType)}
    have = set(raw.columns)
    if spec.symbol_column in have:
        symbol = symbol_of(F.col(spec.symbol_column))
    else:
        symbol = symbol_of(F.col(spec.root_column), F.col(spec.suffix_column) if spec.suffix_column in have else None)
    day = F.col(spec.date_column).cast("string") if spec.date_column in have else F.lit(None).cast("string")
    codes = {}
    if spec.correction_column in have:
        codes["correction"] = quality_code(F.col(spec.correction_column), numeric_text=True)
    if spec.condition_column in have:
        codes["condition"] = quality_code(F.col(spec.condition_column))
    seq = input_order(have, spec)
    times = [spec.timestamp_column] if spec.timestamp_column in have else [spec.date_column, spec.time_column]
    picked = raw.select(
        symbol.alias("symbol"),
        day.alias("raw_date"),
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(times)],
        to_number(F.col(spec.price_column), spec.price_column in text).alias("price"),
        to_number(F.col(spec.size_column), spec.size_column in text).alias("size"),
        *[code.alias(name) for name, code in codes.items()],
        seq.alias("seq"),
    )
    named = {"timestamp_column": "_0"} if len(times) == 1 else {"date_column": "_0", "time_column": "_1"}
    parsed = parse_timestamps(picked, CleanSpec(timezone=spec.timezone, **named)).drop("_0", "_1")
    steps = filter_steps(spec, "correction" in codes, "condition" in codes)
    return assign_split(parsed, split).withColumn("first_fail", first_failure(steps))


def step_names(marked: DataFrame, spec: CleanSpec) -> list[str]:
    return [name for name, _ in filter_steps(spec, "correction" in marked.columns, "condition" in marked.columns)]


def retained(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("first_fail").isNull()).select("symbol", "date", "split", "ts_ns", "seq", "price", "size")


def code_counts(marked: DataFrame) -> DataFrame:
    """Raw correction and condition codes before any filter."""
    kinds = [c for c in ("correction", "condition") if c in marked.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("code")) for k in kinds])
    return marked.select(F.inline(pairs)).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


def raw_sessions(marked: DataFrame) -> DataFrame:
    """Raw rows per symbol and stated date, before any filter."""
    return marked.groupBy("symbol", "raw_date").agg(F.count(F.lit(1)).alias("n"))


def repeats(kept: DataFrame) -> DataFrame:
    """Kept rows after the first per (symbol, time), and per (symbol, time, price, size). Nothing is removed."""
    return repeats_by(kept, [])


def repeats_by(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for each combination of ``keys``, which equal instants must share."""
    prints = kept.groupBy(*keys, "symbol", "ts_ns", "price", "size").agg(F.count(F.lit(1)).alias("n"))
    instants = prints.groupBy(*keys, "symbol", "ts_ns").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("copies"))
    return instants.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("same_symbol_timestamp_ties"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("identical_print_rows"),
    )


def audit_partials(marked: DataFrame) -> DataFrame:
    """Additive counters of one scan as (section, key, n): safe to merge over batches by sum."""
    entry = lambda section, key: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    entries = [
        entry("total", F.lit("input_rows")),
        F.when(F.col("first_fail").isNull(), entry("total", F.lit("retained_rows"))),
        F.when(F.col("first_fail").isNotNull(), entry("filters", F.col("first_fail"))),
        F.when(F.col("raw_date").isNotNull(), entry("raw_sessions", F.concat_ws(" ", "symbol", "raw_date"))),
    ]
    entries += [entry(f"{k}_counts", F.col(k)) for k in ("correction", "condition") if k in marked.columns]
    return (
        marked.select(F.inline(F.array(*entries)))
        .where(F.col("section").isNotNull())
        .groupBy("section", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def warnings_of(totals: DataFrame) -> DataFrame:
    """A row of section ``warnings`` for each kind of repeat that occurs."""
    note = F.when(F.col("key") == "same_symbol_timestamp_ties", TIES_WARNING).when(F.col("key") == "identical_print_rows", COPIES_WARNING)
    return totals.where("n > 0").select(F.lit("warnings").alias("section"), note.alias("key"), F.lit(1).cast("bigint").alias("n")).where("key is not null")


def audit(marked: DataFrame, warnings: Sequence[str] = (), warn_of_repeats: bool = True) -> DataFrame:
    """The whole report as (section, key, n); repeats are counted on kept rows, codes on all rows, each warning is told once.

    ``marked`` is read more than once, so give it landed. Without ``warn_of_repeats`` their counts stand alone."""
    spark = marked.sparkSession
    counted = repeats(retained(marked))
    names = ("same_symbol_timestamp_ties", "identical_print_rows")
    totals = counted.select(
        F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in names]))
    )
    report = audit_partials(marked).unionByName(totals)
    if warn_of_repeats:
        report = report.unionByName(warnings_of(totals))
    if warnings:
        given = spark.createDataFrame([("warnings", w, 1) for w in sorted(set(warnings))], "section string, key string, n bigint")
        report = report.unionByName(given)
    return report
