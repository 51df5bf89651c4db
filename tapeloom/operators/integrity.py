"""Fingerprints and recompute-and-compare audits (L1-L2)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settings_digest(settings: dict) -> str:
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()


def session_fingerprints(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count and order-free sum of row hashes per ``keys``: one partial aggregate, no sort."""
    row = F.xxhash64(*columns).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("hash_sum"))


def portable_fingerprints(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same with md5 over the columns' texts, which any engine can repeat; for whole numbers, texts and dates."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    row = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("hash_sum"))


def fingerprint(df: DataFrame, settings: dict, columns: Sequence[str] | None = None) -> str:
    """One digest of all rows and the settings, equal whatever the row order or partitioning."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("hash_sum")).first()
    return settings_digest({"settings": settings, "columns": columns, "rows": row["rows"], "hash_sum": row.hash_sum})


def require_fingerprint(df: DataFrame, settings: dict, expected: str, columns: Sequence[str] | None = None) -> None:
    if fingerprint(df, settings, columns) != expected:
        raise ValueError("Data or settings differ from the stored fingerprint")


def audit_results(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """Per value: rows on one side only, largest difference, and rows beyond ``tolerance``."""
    a = stored.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = recomputed.select(*keys, F.lit(True).alias("_b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    both = a.join(b, list(keys), "full")
    gap = lambda v: F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))
    either_null = lambda v: F.col(f"_a_{v}").isNull() != F.col(f"_b_{v}").isNull()
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pairs = F.array(
        *[
            F.struct(
                F.lit(v).alias("value"), gap(v).alias("gap"), (~matched).alias("one_side"),
                (matched & (either_null(v) | F.coalesce(gap(v) > tolerance, F.lit(False)))).alias("beyond"),
            )
            for v in values
        ]
    )
    return both.select(F.inline(pairs)).groupBy("value").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("one_side").alias("one_side"), F.max("gap").alias("max_gap"), F.count_if("beyond").alias("beyond")
    )


def require_equal_results(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> None:
    if audit_results(stored, recomputed, keys, values, tolerance).where("one_side > 0 or beyond > 0").limit(1).count():
        raise ValueError("Stored results differ from the recomputed ones")
