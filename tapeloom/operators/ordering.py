"""Order-dependent work on sessions of any size.

A window over (symbol, date) would put a whole session into one task, and one busy session may hold
a third of all rows. Instead each row first gets its dense position in the session from a range
partitioning (which splits sessions at will), and every later frame runs over chunks of a fixed
number of positions plus the few neighbouring rows the frame can reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import search
from ..runtime import land

CHUNK_ROWS = 1 << 16
SKETCH_SIZE = 4_000
_SLOT_MASK = (1 << 33) - 1


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", total: str | None = None
) -> DataFrame:
    """Dense 0-based rank of each row within ``keys`` by ``order``, which must be unique and non-null.

    The range-partitioned rows are landed once, so partition numbers mean the same to the count and
    to the join even when a task is run again.
    """
    sort = [*keys, *order]
    placed = land(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK))),
        "placed",
    )
    spans = placed.groupBy(*keys, "_part").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    spans = spans.select(*keys, "_part", shift, *extra)
    return (
        placed.join(spans, [*keys, "_part"])
        .withColumn(name, F.col("_slot") + F.col("_shift"))
        .drop("_part", "_slot", "_shift")
    )


def with_chunks(
    df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0
) -> tuple[DataFrame, Window]:
    """Copy each row to its chunk and to the neighbours that may look at it.

    Returns the copies with ``_own`` (true on the row's own chunk) and the window that orders one
    chunk. A frame of at most ``before`` rows back and ``after`` rows ahead is exact on own rows.
    """
    # A frame must not reach past the neighbouring chunk.
    rows = max(CHUNK_ROWS, before, after)
    home, offset = chunk_of(pos, rows), F.col(pos) % rows
    ends, starts = offset >= rows - before, (offset < after) & (home > 0)
    if before and after:
        homes = F.when(ends & starts, F.array(home - 1, home, home + 1)).when(ends, F.array(home, home + 1)).when(starts, F.array(home - 1, home))
    elif before:
        homes = F.when(ends, F.array(home, home + 1))
    else:
        homes = F.when(starts, F.array(home - 1, home))
    chunk = F.explode(homes.otherwise(F.array(home))) if before or after else home
    copies = df.withColumn("_chunk", chunk).withColumn("_own", F.col("_chunk") == home)
    return copies, Window.partitionBy(*keys, "_chunk").orderBy(pos)


def chunk_of(pos: str, rows: int) -> Column:
    return F.expr(f"`{pos}` div {rows}L")


def framed(
    df: DataFrame, keys: Sequence[str], pos: str, columns, before: int = 0, after: int = 0
) -> DataFrame:
    """Add window columns: ``columns`` maps the chunk's ordered window to ``{name: column}``."""
    copies, window = with_chunks(df, keys, pos, before, after)
    return copies.withColumns(columns(window)).where("_own").drop("_chunk", "_own")


def running_totals(
    df: DataFrame, keys: Sequence[str], pos: str, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums from the start of the session: chunk totals first, then rows within a chunk."""
    copies, window = with_chunks(df.withColumns({f"_add_{k}": v for k, v in sums.items()}), keys, pos)
    per_chunk = copies.groupBy(*keys, "_chunk").agg(*[F.sum(f"_add_{k}").alias(f"_all_{k}") for k in sums])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums]
    )
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    return (
        copies.join(offsets, [*keys, "_chunk"])
        .withColumns({k: F.col(f"_base_{k}") + F.sum(f"_add_{k}").over(upto) for k in sums})
        .drop("_chunk", "_own", *[f"_{p}_{k}" for k in sums for p in ("add", "base")])
    )


def spread(big: DataFrame, per_key: DataFrame, keys: Sequence[str], pos: str, sizes: DataFrame) -> DataFrame:
    """Join one row, or a few, per key to all rows of the key, chunk by chunk.

    A join on the key alone would send a busy key to one task. ``sizes`` holds the key and ``rows``,
    one more than its largest ``pos``; each row of ``per_key`` is repeated once per chunk, not per row.
    """
    last = F.expr(f"(`rows` - 1) div {CHUNK_ROWS}L")
    repeated = per_key.join(sizes.select(*keys, "rows"), list(keys)).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return big.withColumn("_chunk", chunk_of(pos, CHUNK_ROWS)).join(repeated.drop("rows"), [*keys, "_chunk"]).drop("_chunk")


def require_finite(df: DataFrame, columns: Sequence[str]) -> None:
    """NaN and infinite values have no place in an order; they are refused by count, whatever the number of rows."""
    real = [c for c in columns if df.schema[c].dataType.typeName() in ("double", "float")]
    if real:
        odd = df.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in real]).first()
        bad = {c: odd[c] for c in real if odd[c]}
        if bad:
            raise ValueError(f"Values that are not finite: {bad}")


def order_statistics(
    df: DataFrame, ranks: dict[str, Sequence[int]], counts: dict[str, int], gather: int = 100_000, accuracy: int = 2_000
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ``ranks`` of each column's sorted non-null values, without sorting the columns.

    A mergeable quantile sketch proposes values around every wanted rank, and one count of the rows
    below, on and between them tells for certain where each rank falls. Ranks that fall on a proposed
    value are settled, however many rows tie there; the others leave an open interval about 500 times
    smaller. Once the intervals together hold at most ``gather`` rows, those are looked at directly.
    """
    for c, wanted in ranks.items():
        if any(not 0 <= r < counts[c] for r in wanted):
            raise ValueError(f"Rank outside the {counts[c]} values of {c}")
    require_finite(df, [c for c, wanted in ranks.items() if wanted])
    found: dict[tuple[str, int], float] = {}
    # (column, low, high), both ends excluded, to (rows before it, rows in it, ranks in it).
    open_ = {(c, None, None): (0, counts[c], sorted(set(wanted))) for c, wanted in ranks.items() if wanted}
    while open_:
        if sum(n for _, n, _ in open_.values()) <= gather:
            found.update(_look_up(df, open_))
            break
        proposals = _propose(df, open_, accuracy)
        tallies = _tally(df, proposals)
        narrowed: dict = {}
        for (c, _, _), (_, _, wanted) in open_.items():
            ends = proposals[c]
            for r in wanted:
                before = 0
                for code in range(2 * len(ends) + 1):
                    n = tallies.get((c, code), 0)
                    if r < before + n:
                        break
                    before += n
                if code % 2:
                    found[c, r] = ends[code // 2]
                    continue
                j = code // 2
                interval = (c, ends[j - 1] if j else None, ends[j] if j < len(ends) else None)
                narrowed.setdefault(interval, (before, n, []))[2].append(r)
        open_ = narrowed
    return found


def _between(column: str, ends: Sequence[float]) -> Column:
    """2j + 1 for the value ``ends[j]``, 2j for one between ``ends[j - 1]`` and ``ends[j]``; ``ends`` ascend."""
    value = F.col(column)
    leaf = lambda k: F.when(value == F.lit(ends[k - 1]), 2 * k - 1).otherwise(2 * k) if k else F.lit(0)
    return search(value, ends, leaf)


def _coded(df: DataFrame, ends: dict[str, list[float]], codes: dict[str, list[int]] | None = None) -> DataFrame:
    """One row (column, code, value) per non-null value, or only those of ``codes``; each branch scans its column alone."""
    out = None
    for c, e in ends.items():
        part = df.select(F.lit(c).alias("c"), _between(c, e).alias("code"), F.col(c).alias("v")).where(F.col("v").isNotNull())
        if codes is not None:
            part = part.where(F.col("code").isin(codes[c]))
        out = part if out is None else out.unionByName(part)
    return out


def _propose(df: DataFrame, open_: dict, accuracy: int) -> dict[str, list[float]]:
    """Ends of the open intervals and sketched values a little below and above each wanted rank."""
    sketches = []
    for (c, low, high), (before, n, wanted) in open_.items():
        # Neighbouring ranks share their proposals.
        runs = [[wanted[0], wanted[0]]]
        for r in wanted[1:]:
            if r - runs[-1][1] <= 4 * n / accuracy:
                runs[-1][1] = r
            else:
                runs.append([r, r])
        shares = sorted({min(1.0, max(0.0, (r - before) / n + side / accuracy)) for run in runs for r, side in zip(run, (-2, 2))})
        inside = F.col(c).isNotNull()
        inside = inside if low is None else inside & (F.col(c) > F.lit(low))
        inside = inside if high is None else inside & (F.col(c) < F.lit(high))
        wanted_shares = F.array(*[F.lit(s) for s in shares])
        sketches.append((F.kll_sketch_agg_double(F.when(inside, F.col(c)), F.lit(SKETCH_SIZE)), wanted_shares))
    merged = df.agg(*[sketch.alias(f"k{i}") for i, (sketch, _) in enumerate(sketches)])
    row = merged.select(*[F.kll_sketch_get_quantile_double(f"k{i}", at).alias(f"s{i}") for i, (_, at) in enumerate(sketches)]).first()
    ends: dict[str, set[float]] = {}
    for i, (c, low, high) in enumerate(open_):
        ends.setdefault(c, set()).update(v for v in (*row[f"s{i}"], low, high) if v is not None)
    return {c: sorted(values) for c, values in ends.items()}


def _tally(df: DataFrame, ends: dict[str, list[float]]) -> dict[tuple[str, int], int]:
    rows = _coded(df, ends).groupBy("c", "code").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r.c, r.code): r.n for r in rows}


def _look_up(df: DataFrame, open_: dict) -> dict[tuple[str, int], float]:
    """Values at the ranks of intervals that are small by count: each is one sorted list of bounded length."""
    ends: dict[str, set[float]] = {}
    for c, low, high in open_:
        ends.setdefault(c, set()).update(v for v in (low, high) if v is not None)
    ordered = {c: sorted(values) for c, values in ends.items()}
    places = {(c, 0 if low is None else 2 * ordered[c].index(low) + 2): at for (c, low, _), at in open_.items()}
    here = lambda c, code: (F.col("c") == c) & (F.col("code") == code)
    wanted = F.coalesce(*[F.when(here(c, code), F.array(*[F.lit(r - before) for r in at])) for (c, code), (before, _, at) in places.items()])
    codes = {c: [code for column, code in places if column == c] for c in ordered}
    lists = _coded(df, ordered, codes).withColumn("at", wanted).groupBy("c", "code", "at")
    sorted_lists = lists.agg(F.sort_array(F.collect_list("v")).alias("vs"))
    rows = sorted_lists.select("c", "code", F.transform("at", lambda i: F.get(F.col("vs"), i)).alias("picked")).collect()
    return {(r.c, rank): v for r in rows for rank, v in zip(places[r.c, r.code][2], r.picked)}


def interpolate(at: float, low: float, high: float) -> float:
    return low if low == high else low + (high - low) * at


def exact_quantiles(
    df: DataFrame, shares: dict[str, Sequence[float]], counts: dict[str, int] | None = None
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column, exact at any row count."""
    if counts is None:
        row = df.agg(*[F.count(c).alias(c) for c in shares]).first()
        counts = {c: row[c] for c in shares}
    empty = [c for c in shares if not counts[c]]
    if empty:
        raise ValueError(f"No values to take quantiles of: {empty}")
    where = {c: [share * (counts[c] - 1) for share in wanted] for c, wanted in shares.items()}
    ranks = {c: sorted({r for h in hs for r in (int(h), min(int(h) + 1, counts[c] - 1))}) for c, hs in where.items()}
    values = order_statistics(df, ranks, counts)
    return {
        c: [interpolate(h - int(h), values[c, int(h)], values[c, min(int(h) + 1, counts[c] - 1)]) for h in hs]
        for c, hs in where.items()
    }
