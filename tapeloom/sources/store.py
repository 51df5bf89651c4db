"""Extracts, the prepared store and sinks.

Whatever is written is written beside its target, checked, and moved into place whole (``files.staged``): a refused or interrupted
write leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import KEY
from ..operators.integrity import fingerprint, settings_digest
from ..operators.tokens import Binner
from .files import MODES, move, remove, staged


def select_prints(
    df: DataFrame, symbols: Sequence[str], days: Sequence[str], start: str, end: str, columns: Sequence[str],
    root: str = "sym_root", suffix: str = "sym_suffix", date: str = "date", time: str = "time_m", price: str = "price", size: str = "size",
) -> DataFrame:
    """Rows of plain listings of ``symbols`` on ``days`` within ``[start, end)``; keys as text, price and size double.

    The predicates are plain comparisons of columns, so a Parquet or JDBC scan evaluates or prunes by them.
    """
    plain = F.col(suffix).isNull() | (F.trim(F.col(suffix)) == "")
    wanted = df.where(F.col(root).isin(*symbols) & F.col(date).isin(*days) & (F.col(time) >= start) & (F.col(time) < end) & plain)

    def shaped(name: str) -> Column:
        if name in (price, size):
            return F.col(name).cast("double").alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return wanted.select(*[shaped(c) for c in dict.fromkeys([root, suffix, date, time, price, size, *columns])])


def extract_prints(df: DataFrame, symbols, days, start: str, end: str, columns, out: str, mode: str = "errorifexists", **names) -> DataFrame:
    """Write the selection by day and return its row-count manifest; a declared day without rows is an error and nothing is published."""
    date = names.get("date", "date")
    chosen = select_prints(df, symbols, days, start, end, columns, **names)
    with staged(df.sparkSession, out, mode) as beside:
        # Rebalancing splits a heavy day over several files and joins light ones.
        chosen.hint("rebalance", date).write.partitionBy(date).parquet(beside)
        counts = df.sparkSession.read.option("basePath", beside).schema(chosen.schema).parquet(beside)
        counted = day_manifest(counts, days, date).collect()  # one row for each declared day
        empty = [row[date] for row in counted if not row["n"]]
        if empty:
            raise ValueError(f"No rows on {sorted(empty)}")
    return df.sparkSession.createDataFrame(counted, f"{date} string, n bigint")


def day_manifest(extract: DataFrame, days: Sequence[str], date: str = "date") -> DataFrame:
    declared = extract.sparkSession.createDataFrame([(d,) for d in days], f"{date} string")
    counts = extract.groupBy(F.col(date).cast("string").alias(date)).agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counts, date, "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: What a prepared store is told apart by; a store of another layout is refused.
LAYOUT = 1


@dataclass(frozen=True)
class Store:
    """A prepared store that has been opened: its tables, fitted bins and what its manifest says."""

    events: DataFrame
    sessions: DataFrame
    audit: DataFrame
    binner: Binner
    manifest: dict


def write_prepared(events: DataFrame, sessions: DataFrame, audit: DataFrame, binner: Binner, settings: dict, root: str, mode: str = "errorifexists") -> dict:
    """Publish coded events by split and date with their sessions, audit and bins, and return the manifest.

    Tables go to a folder of their own under ``root``; the manifest, which names it, is moved into place last, in one step. So readers see
    the old store or the new one, never a part, and an interrupted overwrite leaves the old one. The manifest holds the settings with
    their digest and one fingerprint for each table, taken from what was written.
    """
    spark = events.sparkSession
    if mode not in MODES:
        raise ValueError(f"The mode is one of {MODES}")
    old = read_manifest(spark, root)
    if old and mode == "errorifexists":
        raise FileExistsError(f"{root} already exists")
    name = f"data-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    try:
        # Partitions are balanced by size, not one file for each session.
        placed = events.hint("rebalance", "split", "date").sortWithinPartitions("split", *KEY, "e")
        placed.write.partitionBy("split", "date").parquet(f"{folder}/events")
        sessions.write.parquet(f"{folder}/sessions")
        audit.write.parquet(f"{folder}/audit")
        binner.to_frame(spark).coalesce(1).write.parquet(f"{folder}/bins")
        kept = {t: schema.jsonValue() for t, schema in (("events", events.schema), ("sessions", sessions.schema), ("audit", audit.schema))}
        manifest = {"layout": LAYOUT, "data": name, "settings": settings, "settings_digest": settings_digest(settings), "schemas": kept}
        manifest["fingerprints"] = {t: fingerprint(df, settings) for t, df in _tables(spark, root, manifest).items()}
        _publish(spark, root, manifest)
    except BaseException:
        remove(spark, folder)
        raise
    if old:
        remove(spark, f"{root}/{old['data']}")
    return manifest


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    beside = f"{root}/_manifest.{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(beside)
    move(spark, beside, f"{root}/manifest-{_number(spark, root) + 1:08d}")


def _manifests(spark: SparkSession, root: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().getName() for status in found or [])


def _number(spark: SparkSession, root: str) -> int:
    names = _manifests(spark, root)
    return int(names[-1].rpartition("-")[2]) if names else 0


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest; None if nothing was ever published whole."""
    names = _manifests(spark, root)
    return json.loads(spark.read.text(f"{root}/{names[-1]}").first().value) if names else None


def _tables(spark: SparkSession, root: str, manifest: dict) -> dict[str, DataFrame]:
    out = {}
    for t, schema in manifest["schemas"].items():
        kind = T.StructType.fromJson(schema)
        df = spark.read.schema(kind).parquet(f"{root}/{manifest['data']}/{t}")
        out[t] = df.select(*kind.names)
    out["bins"] = spark.read.parquet(f"{root}/{manifest['data']}/bins")
    return out


def open_prepared(spark: SparkSession, root: str, settings: dict) -> Store:
    """Open a published store. Other settings, another layout or any changed row of any table are refused before a row can be used."""
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"No prepared store at {root}")
    if manifest["layout"] != LAYOUT:
        raise ValueError(f"{root} has layout {manifest['layout']}, not {LAYOUT}")
    if settings_digest(manifest["settings"]) != manifest["settings_digest"] or settings_digest(settings) != manifest["settings_digest"]:
        theirs = json.loads(json.dumps(settings))
        keys = sorted(k for k in {*theirs, *manifest["settings"]} if theirs.get(k) != manifest["settings"].get(k))
        raise ValueError(f"{root} was prepared with other settings: {keys}")
    tables = _tables(spark, root, manifest)
    changed = sorted(t for t, df in tables.items() if fingerprint(df, settings) != manifest["fingerprints"][t])
    if changed:
        raise ValueError(f"Tables of {root} differ from their fingerprints: {changed}")
    return Store(tables["events"], tables["sessions"], tables["audit"], Binner.from_frame(tables["bins"]), manifest)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Any result table as CSV with a header (arrays as JSON text) or, by extension, as Parquet."""
    with staged(df.sparkSession, path, mode) as beside:
        if path.rstrip("/").lower().endswith(".parquet"):
            df.write.parquet(beside)
            return
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).csv(beside)
