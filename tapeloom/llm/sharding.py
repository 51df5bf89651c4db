"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input part a uniform shuffle sends to each shard follows a multivariate hypergeometric law, given the
parts' row counts. The matrix is drawn down a binary tree of parts: the shard counts of a range of parts split into those of its halves by
one multivariate draw, seeded by the range. So a task gets its own row of the matrix, and the rows before it, from the draws on its
path alone, and nobody holds the matrix. Each part then permutes its rows and deals them by its row of the matrix, rows are
exchanged, and each shard permutes what it got. Both permutations are keyed bijections of row numbers, so no part and no shard
has to be held by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import land
from .chunks import width
from .scan import mix

SHARDS = 40


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of ``0 .. size - 1`` at each index: a Feistel network over the next power of four, walked back into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    key = mix(key.astype(np.uint64))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for turn in range(6):
            left, right = right, left ^ (mix(right + key[todo] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & low[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    return sizes


def matrix_row(ends: np.ndarray, shards: int, seed: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ``part`` sends to each shard, and those that the parts before it send; ``ends`` are the running row counts of the parts."""
    low, high = 0, len(ends)
    upto = lambda k: int(ends[k - 1]) if k else 0
    own, before = shard_sizes(upto(high), shards), np.zeros(shards, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = spread_rows(np.random.default_rng([seed, low, high]), own, upto(middle) - upto(low))
        if part < middle:
            own, high = left, middle
        else:
            own, before, low = own - left, before + left, middle
    return own, before


def spread_rows(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How ``n`` rows drawn from shards of these ``sizes`` fall to them: one hypergeometric draw for each shard, given those before it."""
    out, rest = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for s, free in enumerate(sizes.tolist()):
        out[s] = hypergeometric(rng, free, rest - free, n)
        n -= int(out[s])
        rest -= free
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn of ``good`` + ``bad``, exact at every size."""
    # numpy takes fewer than a billion of each kind.
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    if n > (good + bad) // 2:
        return good - hypergeometric(rng, good, bad, good + bad - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    return _by_rejection(rng, good, bad, n)


def _by_rejection(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Ratio of uniforms under the table mountain hat of the law (Stadlober 1990), for good <= bad and n at most half of all."""
    total = good + bad
    share = good / total
    mean = n * share
    width = ((total - n) / (total - 1) * n * share * (1 - share) + 0.5) ** 0.5
    hat = 2 * (2 / math.e) ** 0.5 * width + 3 - 2 * (3 / math.e) ** 0.5
    mode = (n + 1) * (good + 1) // (total + 2)
    while True:
        u = 1.0 - rng.random()
        at = mean + 0.5 + hat * (rng.random() - 0.5) / u
        if not 0 <= at < min(n, good) + 1:
            continue
        k = int(at)
        if 2 * math.log(u) <= _log_ratio(k, mode, good, bad, n):
            return k


def _log_ratio(k: int, mode: int, good: int, bad: int, n: int) -> float:
    """Log of P(k) / P(mode)."""
    return -sum(_log_factorials(a, b) for a, b in ((k, mode), (good - k, good - mode), (n - k, n - mode), (bad - n + k, bad - n + mode)))


def _log_factorials(a: int, b: int) -> float:
    """log(a! / b!). Of large numbers their difference is taken inside Stirling's series, where nothing large cancels."""
    if min(a, b) < 1_000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return d * math.log(b) + (a + 0.5) * math.log1p(d / b) - d + series(a) - series(b)


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, dealt out by shard and ordered by slot in each task.

    Counts are at most one apart, slots of a shard have no gap, and repeated or null rows are rows like others. Columns named
    ``shard`` or ``slot`` are replaced. The same input parts and seed give the same shuffle.
    """
    docs = docs.drop("shard", "slot")
    taken = {c.lower() for c in docs.columns}
    row, dealt_ = (next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in ("row", "dealt"))
    landed = land(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright(row, 33).cast("int"), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    counted = landed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    number = {r["part"]: i for i, r in enumerate(counted)}
    rows = np.array([r["n"] for r in counted], np.int64)
    ends = np.cumsum(rows)
    totals = shard_sizes(int(ends[-1]) if len(ends) else 0, shards)

    @F.pandas_udf("shard int, slot long")
    def deal(parts: pd.Series, places: pd.Series) -> pd.DataFrame:
        i = parts.map(number).to_numpy(np.int64)
        at = permuted(places.to_numpy(np.int64), rows[i], i + (seed << 20))
        shard, nth = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for p in np.unique(i).tolist():
            own = i == p
            sent, before = matrix_row(ends, shards, seed, p)
            until = np.cumsum(sent)
            shard[own] = np.searchsorted(until, at[own], "right")
            nth[own] = before[shard[own]] + at[own] - (until - sent)[shard[own]]
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": permuted(nth, totals[shard], shard + (seed << 40))})

    dealt = landed.withColumn(dealt_, deal(part, place)).select(*[F.col(f"`{c}`") for c in docs.columns], f"{dealt_}.shard", f"{dealt_}.slot")
    starts = F.array(*[F.lit(int(x)).cast("long") for x in np.cumsum(totals) - totals])
    place_in_all = F.get(starts, F.col("shard")) + F.col("slot")
    n = width(docs.sparkSession)
    task = F.floor(place_in_all * F.lit(n) / F.lit(float(max(1, totals.sum())))).cast("int")
    return dealt.repartitionById(n, F.least(task, F.lit(n - 1))).sortWithinPartitions("shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """One folder ``shard=k`` for each shard."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """One row per document: its size and checksum, derived from the shuffled texts, its shard and its slot."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.coalesce("text", F.lit(""))
    return shuffled(chosen, shards, seed).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
