"""Exact nanosecond timestamps. Spark timestamps stop at microseconds, so times travel as BIGINT."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS = 1_000_000_000
# Fixed value: accepted ISO spellings as date, time of day, fraction and zone.
ISO = r"^(\d{4})-?(\d{2})-?(\d{2})([ T]\d{1,2}:\d{2}(?::\d{2})?)?(?:(?<=:\d{2})\.(\d+))?\s*((?<=[:\d\s])(?:Z|[+-]\d{2}:?\d{2}))?$"
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z")


def iso_parts(text: Column) -> Column:
    """``date time|fraction|zone`` by one regular expression; text that is not ISO stays as it is."""
    return F.regexp_replace(text, ISO, "$1-$2-$3$4|$5|$6")


def part(parts: Column, n: int) -> Column:
    return F.split_part(parts, F.lit("|"), F.lit(n))


def wall_seconds(clock: Column) -> Column:
    """Clock reading ``yyyy-MM-dd[ HH:mm[:ss]]`` as seconds since 1970 on the same clock."""
    day = F.length(clock) <= 10
    short = F.substring_index(clock, ":", 2) == clock
    full = F.concat(clock, F.when(day, " 00:00:00Z").when(short, ":00Z").otherwise("Z"))
    return F.unix_seconds(full.try_cast("timestamp"))


def in_range(seconds: Column) -> Column:
    """Within the years 1678-2261, where nanoseconds fit a BIGINT."""
    return F.when(seconds.between(-9214560000, 9214646399), seconds)


def fraction_nanos(digits: Column) -> Column:
    return F.substring(F.rpad(digits, 9, "0"), 1, 9).cast("bigint")


def zone_seconds(zone: Column) -> Column:
    """Offset of ``Z``, ``+hh:mm`` or ``-hhmm``."""
    size = F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.right(zone, F.lit(2)).try_cast("bigint") * 60
    return F.when(zone == "Z", F.lit(0)).when(zone.startswith("-"), -size).otherwise(size)


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of a zone by time, one row for each bucket of a mean year: its ``stride`` times of change, ascending, and the offsets
    before, between and after them. An offset of ``UNCLEAR`` stands where the clock skips a reading or shows it twice.
    """

    stride: int
    rows: tuple[tuple[int, ...], ...]

    def offsets(self, df: DataFrame, seconds: str, name: str) -> DataFrame:
        """Add the offset at ``seconds`` as ``name``, null where there is none: a lookup in a few hundred rows and some comparisons."""
        edges, offsets = [f"_edge{i}" for i in range(self.stride)], [f"_offset{i}" for i in range(self.stride + 1)]
        table = df.sparkSession.createDataFrame(self.rows, ", ".join(f"{c} long" for c in ("_bucket", *edges, *offsets)))
        placed = df.withColumn("_bucket", F.floor(F.col(seconds) / BUCKET)).join(F.broadcast(table), "_bucket", "left")
        found = F.col(offsets[0])
        for edge, after in zip(edges, offsets[1:]):
            found = F.when(F.col(seconds) >= F.col(edge), F.col(after)).otherwise(found)
        return placed.withColumn(name, found).withColumn(name, F.when(F.col(name) != UNCLEAR, F.col(name))).drop("_bucket", *edges, *offsets)


#: Seconds of a bucket: a mean Gregorian year. UNCLEAR is no offset of any zone.
BUCKET, UNCLEAR = 31_556_952, 1 << 40
_FROM, _TO = -9_214_560_000, 9_214_646_400


@cache
def transitions(timezone: str) -> tuple[int, tuple[tuple[int, int, int], ...]]:
    """The zone's first offset and its changes as (UTC second, offset before, offset after), in the years that BIGINT nanoseconds reach."""
    zone, epoch = ZoneInfo(timezone), datetime(1970, 1, 1, tzinfo=UTC)

    def at(second: int) -> int:
        return int((epoch + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    found, low, before = [], _FROM, at(_FROM)
    first = before
    while low < _TO:
        high = low + 86_400
        after = at(high)
        if after != before:
            a, b = low, high
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if at(middle) == before else (a, middle)
            found.append((b, before, after))
        low, before = high, after
    return first, tuple(found)


def _table(first: int, steps: list[tuple[int, int]]) -> ZoneTable:
    """Buckets of (time from which, offset), ascending; ``first`` holds before all of them."""
    start, end = _FROM // BUCKET - 1, _TO // BUCKET + 2
    own: dict[int, list[tuple[int, int]]] = {}
    for at, offset in steps:
        own.setdefault(at // BUCKET, []).append((at, offset))
    stride = max(map(len, own.values()), default=1)
    rows, now = [], first
    for bucket in range(start, end):
        here = own.get(bucket, [])
        offsets = [now, *(offset for _, offset in here)]
        now = offsets[-1]
        lacking = stride - len(here)
        rows.append((bucket, *(at for at, _ in here), *[1 << 60] * lacking, *offsets, *[now] * lacking))
    return ZoneTable(stride, tuple(rows))


@cache
def utc_table(timezone: str) -> ZoneTable:
    first, changes = transitions(timezone)
    return _table(first, [(at, after) for at, _, after in changes])


@cache
def wall_table(timezone: str) -> ZoneTable:
    """By clock reading: between the two readings of a change the clock is skipped or shown twice, by however many seconds."""
    first, changes = transitions(timezone)
    steps = [step for at, a, b in changes for step in ((at + min(a, b), UNCLEAR), (at + max(a, b), b))]
    return _table(first, steps)


def with_utc(df: DataFrame, wall: str, timezone: str, name: str) -> DataFrame:
    """Add the UTC second at which the local clock shows ``wall``; null where it skips the reading or shows it twice."""
    return wall_table(timezone).offsets(df, wall, "_shift").withColumn(name, F.col(wall) - F.col("_shift")).drop("_shift")


def with_local(df: DataFrame, utc: str, timezone: str, name: str) -> DataFrame:
    """Add what the local clock shows at the UTC second ``utc``."""
    return utc_table(timezone).offsets(df, utc, "_shift").withColumn(name, F.col(utc) + F.col("_shift")).drop("_shift")


def session_open_ns(date: Column, start_seconds: int, timezone: str) -> Column:
    """Nanoseconds of the session's local opening on ``date``."""
    wall = F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86400 + start_seconds)
    return F.unix_seconds(F.to_utc_timestamp(wall, timezone)) * NANOS
