"""Train-only quantile tokens (D1q-D10q)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bin_of, joint_encode
from .events import BEFORE, FEATURES
from .ordering import exact_quantiles, order_statistics

CODES = ("c0", "c1", "c2")


@dataclass(frozen=True)
class Binner:
    """Fitted parameters: a few dozen numbers, the only thing about events that reaches the driver."""

    bins: int
    edges: tuple[tuple[float, ...], ...]
    centers: tuple[tuple[float, ...], ...]
    low: tuple[float, ...]
    high: tuple[float, ...]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, list(self.edges[i]), list(self.centers[i]), self.low[i], self.high[i]) for i in range(len(self.edges))
        ]
        return spark.createDataFrame(rows, "field int, edges array<double>, centers array<double>, mn double, mx double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> Binner:
        rows = df.orderBy("field").collect()
        return cls(
            len(rows[0].centers),
            tuple(tuple(r.edges) for r in rows),
            tuple(tuple(r.centers) for r in rows),
            tuple(r.mn for r in rows),
            tuple(r.mx for r in rows),
        )


def training_summary(train: DataFrame) -> dict:
    """Row count, range and finiteness of the fields in one pass; empty or non-finite input is an error."""
    exprs = []
    for f in FEATURES:
        finite = F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf"))
        exprs += [F.min(f).alias(f"mn_{f}"), F.max(f).alias(f"mx_{f}"), F.count_if(~finite).alias(f"bad_{f}")]
    row = train.agg(F.count(F.lit(1)).alias("n"), *exprs).first()
    if not row.n:
        raise ValueError("No training events to fit bins on")
    if any(row[f"bad_{f}"] for f in FEATURES):
        raise ValueError("Training features must be finite")
    return row.asDict()


def fit_edges(train: DataFrame, bins: int, method: str = "rank", summary: dict | None = None) -> list[list[float]]:
    """Quantiles k/bins of each field. ``rank`` is exact; ``kll`` is a sketch of about 1% rank error."""
    shares = [k / bins for k in range(1, bins)]
    if method == "kll":
        sketches = train.agg(*[F.kll_sketch_agg_double(f, F.lit(4000)).alias(f) for f in FEATURES])
        wanted = F.array(*[F.lit(s) for s in shares])
        row = sketches.select(*[F.kll_sketch_get_quantile_double(f, wanted).alias(f) for f in FEATURES]).first()
        return [list(row[f]) for f in FEATURES]
    if method != "rank":
        raise ValueError("The method is rank or kll")
    n = (summary or training_summary(train))["n"]
    found = exact_quantiles(train, {f: shares for f in FEATURES}, {f: n for f in FEATURES})
    return [found[f] for f in FEATURES]


def fit_bins(train: DataFrame, bins: int, method: str = "rank") -> Binner:
    """Edges, centres and range from training events only. Equal edges are allowed, so bins may be empty."""
    summary = training_summary(train)
    n = summary["n"]
    edges = fit_edges(train, bins, method, summary)
    reached = train.agg(
        *[F.count_if(F.col(f) >= F.lit(float(edge))).alias(f"n{i}_{k}") for i, f in enumerate(FEATURES) for k, edge in enumerate(edges[i])]
    ).first()
    # A bin holds one run of sorted values, so its median is an order statistic of the whole field.
    middles, empties = {}, {}
    for i, f in enumerate(FEATURES):
        upper = [n, *[reached[f"n{i}_{k}"] for k in range(bins - 1)], 0]
        start = 0
        for b in range(bins):
            size = upper[b] - upper[b + 1]
            if size:
                middles[i, b] = (start + (size - 1) // 2, start + size // 2)
            else:
                empties[i, b] = (b + 0.5) / bins * (n - 1)
            start += size
    ranks = {
        f: [r for (j, _), pair in middles.items() if j == i for r in pair]
        + [r for (j, _), h in empties.items() if j == i for r in (math.floor(h), min(math.floor(h) + 1, n - 1))]
        for i, f in enumerate(FEATURES)
    }
    values = order_statistics(train, ranks, {f: n for f in FEATURES})
    centers = []
    for i, f in enumerate(FEATURES):
        row = []
        for b in range(bins):
            if (i, b) in middles:
                lo, hi = middles[i, b]
                row.append((values[f, lo] + values[f, hi]) / 2)
            else:
                h = empties[i, b]
                lo, hi = values[f, math.floor(h)], values[f, min(math.floor(h) + 1, n - 1)]
                row.append(lo + (hi - lo) * (h - math.floor(h)))
        centers.append(tuple(row))
    return Binner(
        bins,
        tuple(tuple(e) for e in edges),
        tuple(centers),
        tuple(summary[f"mn_{f}"] for f in FEATURES),
        tuple(summary[f"mx_{f}"] for f in FEATURES),
    )


def assign_bins(events: DataFrame, edges, source=FEATURES, target=CODES) -> DataFrame:
    """Map-only: compare with literal edges; a value on an edge belongs to the upper bin."""
    return events.withColumns({c: bin_of(F.col(f), edges[i]) for i, (f, c) in enumerate(zip(source, target))})


def tokenise(events: DataFrame, binner: Binner) -> DataFrame:
    """Add codes ``c0..c2`` and joint ``token``, and ``prev``, the token of the event before (null on the first)."""
    coded = assign_bins(events, binner.edges)
    before = F.when(
        F.col(BEFORE[0]).isNotNull(), joint_encode([bin_of(F.col(g), binner.edges[i]) for i, g in enumerate(BEFORE)], binner.bins)
    )
    return coded.withColumn("token", joint_encode([F.col(c) for c in CODES], binner.bins)).withColumn("prev", before)


def decode_bin(code: Column, centers) -> Column:
    return F.element_at(F.array(*[F.lit(float(c)) for c in centers]), (code + 1).cast("int"))


def decode_bins(coded: DataFrame, binner: Binner, codes=CODES) -> DataFrame:
    """Typical seconds, basis points and size of each event's bins."""
    values = [decode_bin(F.col(c), binner.centers[i]) for i, c in enumerate(codes)]
    return coded.withColumns({"seconds": F.expm1(values[0]), "return_bps": values[1], "size": F.expm1(values[2])})


def bin_occupancy(coded: DataFrame, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events per field and bin, with a row for every empty bin."""
    pairs = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("bin")) for i, c in enumerate(CODES)])
    counts = coded.select(*keys, F.inline(pairs)).groupBy(*keys, "field", "bin").agg(F.count(F.lit(1)).alias("n"))
    spark = coded.sparkSession
    grid = spark.range(3 * bins).select(F.floor(F.col("id") / bins).cast("int").alias("field"), (F.col("id") % bins).cast("int").alias("bin"))
    if keys:
        grid = counts.select(*keys).distinct().withColumn("_all", F.sequence(F.lit(0), F.lit(3 * bins - 1)))
        grid = grid.select(*keys, F.explode("_all").alias("id")).select(
            *keys, F.floor(F.col("id") / bins).cast("int").alias("field"), (F.col("id") % bins).cast("int").alias("bin")
        )
    return grid.join(counts, [*keys, "field", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
