"""Micro-batch ingestion whose landed result equals cleaning the whole table at once (A10).

Every batch lands its kept rows by bucket of time, its additive counters and the list of buckets it touched, each in a folder named by
the batch: a batch that runs again replaces them and counts nothing twice. Ties and copies can straddle batches but never buckets, so an
audit counts anew only the buckets that batches have touched since the last one and keeps the tallies of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanSpec, SplitSpec
from ..functions.times import NANOS
from ..operators.clean import annotate, audit_partials, kinds_of_times, refuse_mix, repeats_by, retained, warnings_of
from ..sources.files import exists, staged

#: Seconds of a bucket: equal instants are in one bucket.
BUCKET_SECONDS = 86_400
TALLIES = ("same_symbol_timestamp_ties", "identical_print_rows")


def clean_stream(raw: DataFrame, clean: CleanSpec, split: SplitSpec, out: str, checkpoint: str) -> None:
    """Clean every available file of a streaming DataFrame into ``out``.

    The feed must bring its own sequence column, as batch boundaries say nothing about order.
    """
    if clean.seq_column not in [c.lower() for c in raw.columns]:
        raise ValueError(f"Streaming needs the feed sequence column {clean.seq_column}")

    def land_batch(batch: DataFrame, number: int) -> None:
        marked = annotate(batch, clean, split).persist()
        try:
            refuse_mix(marked.agg(*kinds_of_times()).first().asDict())
            kept = retained(marked).withColumn("bucket", F.expr(f"ts_ns div {BUCKET_SECONDS * NANOS}L"))
            kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/kept/batch={number}")
            audit_partials(marked).write.mode("overwrite").parquet(f"{out}/counters/batch={number}")
            # Last: what is listed here has been landed whole.
            kept.select("bucket").distinct().write.mode("overwrite").parquet(f"{out}/touched/batch={number}")
        finally:
            marked.unpersist()

    query = raw.writeStream.foreachBatch(land_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _landed(spark: SparkSession, out: str) -> DataFrame:
    schema = "symbol string, date date, split string, ts_ns long, seq long, price double, size double, batch long, bucket long"
    return spark.read.schema(schema).parquet(f"{out}/kept")


def landed_prints(spark: SparkSession, out: str) -> DataFrame:
    return _landed(spark, out).drop("batch", "bucket")


def pending_buckets(spark: SparkSession, out: str) -> list[int]:
    """Buckets with a batch that the stored tallies have not seen."""
    latest = spark.read.schema("bucket long, batch long").parquet(f"{out}/touched").groupBy("bucket").agg(F.max("batch").alias("batch"))
    if exists(spark, f"{out}/tallies"):
        seen = spark.read.parquet(f"{out}/tallies").select("bucket", F.col("batch").alias("seen"))
        latest = latest.join(seen, "bucket", "left").where("seen is null or seen < batch")
    return sorted(r.bucket for r in latest.select("bucket").collect())


def update_tallies(spark: SparkSession, out: str) -> list[int]:
    """Bring the stored tallies of repeats up to date and say which buckets were read for it; no other bucket's rows are.

    One row for each bucket: its latest batch, ties and copies. The new table replaces the old one whole.
    """
    buckets = pending_buckets(spark, out)
    if not buckets:
        return []
    fresh = _landed(spark, out).where(F.col("bucket").isin(buckets))
    latest = fresh.groupBy("bucket").agg(F.max("batch").alias("batch"))
    counted = repeats_by(fresh, ["bucket"]).join(latest, "bucket").select("bucket", "batch", *TALLIES)
    if exists(spark, f"{out}/tallies"):
        counted = counted.unionByName(spark.read.parquet(f"{out}/tallies").where(~F.col("bucket").isin(buckets)))
    with staged(spark, f"{out}/tallies", "overwrite") as beside:
        counted.write.parquet(beside)
    return buckets


def landed_audit(spark: SparkSession, out: str, warn_of_repeats: bool = True) -> DataFrame:
    """Counters summed over batches, and the tallies of repeats, brought up to date first; with ``warn_of_repeats`` also their warnings."""
    update_tallies(spark, out)
    counters = spark.read.parquet(f"{out}/counters").groupBy("section", "key").agg(F.sum("n").alias("n"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TALLIES]
    stored = spark.read.parquet(f"{out}/tallies") if exists(spark, f"{out}/tallies") else spark.createDataFrame([], ", ".join(f"{c} long" for c in TALLIES))
    pairs = F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in TALLIES])
    totals = stored.agg(*sums).select(F.inline(pairs))
    report = counters.unionByName(totals)
    return report.unionByName(warnings_of(totals)) if warn_of_repeats else report
