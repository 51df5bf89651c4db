"""Reads the ``events`` table as a tape of raw prints, so that its rows exercise every filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanSpec, ClockSpec, SplitSpec, TokenSpec

DAYS = [f"2024-01-{day:02d}" for day in range(1, 31)]
CLEAN = CleanSpec(
    timezone="UTC",
    session_start="00:00:00",
    session_end="23:00:00",
    allowed_conditions=("", "@", "@F"),
)
SPLIT = SplitSpec(
    seen=("click", "view", "purchase"),
    heldout=("error",),
    train=tuple(DAYS[:18]),
    val=tuple(DAYS[18:24]),
    test=tuple(DAYS[24:]),
)
TOKENS = TokenSpec(bins=8, context=12)
CLOCK = ClockSpec(unit_ns=72_000_000_000, session_units=1150, max_age=60.0, rv_floor=0.0)


def raw_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("sym_root"),
        F.when(user % 29 == 0, "A").otherwise("").alias("sym_suffix"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("date"),
        F.substring(F.col("ts").cast("string"), 12, 18).alias("time_m"),
        F.col("value").alias("price"),
        F.regexp_extract("props", r'"k":\s*(-?[0-9.]+)', 1).alias("size"),
        F.when(user % 17 == 0, "01").when(user % 3 == 0, "0").otherwise("00").alias("tr_corr"),
        F.when(user % 11 == 0, "T").when(user % 7 == 0, "@F").when(user % 2 == 0, "@").otherwise("").alias("tr_scond"),
    )
