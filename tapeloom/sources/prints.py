"""Readers of raw prints (A1-A5).

Every reader adds where a row was (``source_place`` of its path in the given list, ``source_file``, ``source_block``, ``source_row``), so
that equal times keep the order of the input without a feed sequence (B13). What is not used costs nothing: the scan leaves it out.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import PROVENANCE, normalize_columns
from .files import exists, files_under, given_paths, row_in_task, with_provenance
from .zipcsv import ZipCsvSource, archive_members

KINDS = {".csv": "csv", ".csv.gz": "csv", ".zip": "zip", ".parquet": "parquet", ".pq": "parquet"}
#: Heads of CSV files that are looked at together.
HEADS = 16

Given = Sequence[tuple[str, int]]


def text_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header of the first line, read by Spark, so that any file system it knows will do."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"No header in {path}")
    return next(csv.reader([line.value]))


def _listed(paths: Sequence[str] | str) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_prints_csv(spark: SparkSession, paths: Sequence[str] | str, given: Given | None = None, header: Sequence[str] | None = None) -> DataFrame:
    """CSV or gzipped CSV files or folders of one header, every column as text; an empty field stays the empty string."""
    paths = _listed(paths)
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST", "nullValue": "\u0000", "emptyValue": ""}
    df = spark.read.schema(text_schema(header or csv_header(spark, paths[0]))).options(**options).csv(paths)
    # A large file is scanned in blocks, each from top to bottom by one task.
    return with_provenance(normalize_columns(df.na.fill("")), given or given_paths(spark, paths), row_in_task(), F.col("_metadata.file_block_start"))


def read_prints_parquet(spark: SparkSession, paths: Sequence[str] | str, given: Given | None = None) -> DataFrame:
    paths = _listed(paths)
    return with_provenance(normalize_columns(spark.read.parquet(*paths)), given or given_paths(spark, paths), F.col("_metadata.row_index"))


def read_prints_zip(spark: SparkSession, paths: Sequence[str] | str, places: Sequence[int] | None = None, header: Sequence[str] | None = None) -> DataFrame:
    """CSV members of ZIP archives, one task for each member; members of an archive stand in order of name."""
    paths = _listed(paths)
    spark.dataSource.register(ZipCsvSource)
    members = [m for m in archive_members(spark, list(zip(places or range(len(paths)), paths))) if header is None or m[3] == list(header)]
    df = normalize_columns(spark.read.format("zipcsv").option("members", json.dumps(members)).load())
    return df.withColumn("source_block", F.lit(0).cast("bigint"))


def read_prints(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Files of any kinds and folders of such files, as one table in the order of ``paths``.

    Paths are grouped by kind and header, each group is one scan, and columns are matched by name. In a read of several groups every
    column is text, and a column that some group lacks is left out, so that whatever needs it says so.
    """
    groups, given = _catalogue(spark, _listed(paths))
    scans = []
    for (kind, header), found in groups.items():
        if kind == "csv":
            scans.append(read_prints_csv(spark, [path for _, path in found], given, header))
        elif kind == "parquet":
            scans.append(read_prints_parquet(spark, [path for _, path in found], given))
        else:
            scans.append(read_prints_zip(spark, [path for _, path in found], [place for place, _ in found], header))
    if len(scans) == 1:
        return scans[0]
    shared = [c for c in scans[0].columns if all(c in df.columns for df in scans)]
    asked = [df.select(*[F.col(c) if c in PROVENANCE else F.col(c).cast("string").alias(c) for c in shared]) for df in scans]
    out = asked[0]
    for df in asked[1:]:
        out = out.unionByName(df)
    return out


def _catalogue(spark: SparkSession, paths: list[str]) -> tuple[dict[tuple[str, tuple[str, ...]], list[tuple[int, str]]], Given]:
    """(kind, header) to the places and paths that have it, and all given paths with their places.

    A path is of the kind its name ends in; a folder whose name tells no kind is looked through for files. Parquet files carry their
    own columns, so they are one group.
    """
    given, found = [], []
    for place, path in enumerate(paths):
        kind = _kind_of(path)
        if kind == "zip":  # no Spark file source reads these
            found.append((place, kind, path))
            continue
        if not kind and not exists(spark, path):
            _unsupported(path)
        given += [(name, place) for name, _ in given_paths(spark, [path])]
        below = [path] if kind else files_under(spark, path)
        found += [(place, _kind_of(each) or _unsupported(each), each) for each in below]
    names = [name for name, _ in given]
    if len(set(names)) < len(names):
        raise ValueError(f"Paths given twice: {sorted({n for n in names if names.count(n) > 1})}")
    plain = [path for _, kind, path in found if kind == "csv"]
    with ThreadPoolExecutor(HEADS) as pool:
        headers = dict(zip(plain, pool.map(lambda path: tuple(csv_header(spark, path)), plain)))
    archives = [(place, path) for place, kind, path in found if kind == "zip"]
    inside: dict[str, list[tuple[str, ...]]] = {}
    for _, path, _, header in archive_members(spark, archives) if archives else []:
        inside.setdefault(path, []).append(tuple(header))
    groups: dict[tuple[str, tuple[str, ...]], list[tuple[int, str]]] = {}
    for place, kind, path in found:
        for header in dict.fromkeys(inside[path]) if kind == "zip" else [headers.get(path, ())]:
            groups.setdefault((kind, header), []).append((place, path))
    return groups, given


def _kind_of(path: str) -> str | None:
    lower = path.lower().rstrip("/")
    return next((kind for suffix, kind in KINDS.items() if lower.endswith(suffix)), None)


def _unsupported(path: str):
    raise ValueError(f"Unsupported extension: {path}")
