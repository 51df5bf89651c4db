"""Paths as Spark's file systems see them: where a row was read, and results that replace a folder only once they are whole."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("errorifexists", "overwrite")


#: The slashes after a scheme: file:/x and file:///x are one file.
SLASHES = r"^([\w+.-]+:)/+"


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def given_paths(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Each given path, with wildcards filled in, as the address that Spark states for its files, and its place in the list.

    A path that is given twice is refused, as its rows could not be told apart."""
    found: list[tuple[str, int]] = []
    for place, path in enumerate(paths):
        hadoop, system = _path(spark, path)
        statuses = system.globStatus(hadoop)
        if not statuses:
            raise FileNotFoundError(path)
        found += [(re.sub(SLASHES, r"\1", status.getPath().toUri().toString()), place) for status in statuses]
    names = [name for name, _ in found]
    if len(set(names)) < len(names):
        raise ValueError(f"Paths given twice: {sorted({n for n in names if names.count(n) > 1})}")
    return found


def files_under(spark: SparkSession, path: str) -> list[str]:
    """Files in and below a folder, in order of name; hidden ones (``_x``, ``.x``) are none."""
    hadoop, system = _path(spark, path)
    each, found = system.listFiles(hadoop, True), []
    while each.hasNext():
        found.append(each.next().getPath().toString())
    depth = len(re.sub(SLASHES, r"\1", system.makeQualified(hadoop).toString()).rstrip("/"))
    hidden = lambda name: any(part[:1] in "_." for part in re.sub(SLASHES, r"\1", name)[depth + 1 :].split("/"))
    return sorted(name for name in found if not hidden(name))


def place_of(file: Column, given: Sequence[tuple[str, int]]) -> Column:
    """Place in the list of the given path that a file is or lies under: one lookup for each depth that given paths have."""
    file = F.regexp_replace(file, SLASHES, "$1")
    if len({place for _, place in given}) == 1:
        return F.lit(given[0][1])
    by_depth: dict[int, list[tuple[str, int]]] = {}
    for name, place in given:
        by_depth.setdefault(name.count("/"), []).append((name, place))
    lookups = []
    for depth in sorted(by_depth, reverse=True):
        stem = F.substring_index(file, "/", depth + 1)
        lookups.append(_search_text(stem, sorted(by_depth[depth])))
    return F.coalesce(*lookups, F.raise_error(F.concat(F.lit("No given path holds "), file)).cast("int"))


def _search_text(value: Column, named: Sequence[tuple[str, int]]) -> Column:
    """The place of the name that equals ``value``, by a tree of comparisons; null if none does."""
    if len(named) == 1:
        return F.when(value == F.lit(named[0][0]), F.lit(named[0][1]))
    middle = len(named) // 2
    return F.when(value < F.lit(named[middle][0]), _search_text(value, named[:middle])).otherwise(_search_text(value, named[middle:]))


def with_provenance(df: DataFrame, given: Sequence[tuple[str, int]], row: Column, block: Column | None = None) -> DataFrame:
    file = F.col("_metadata.file_path")
    placed = df.withColumns({"source_file": file, "source_block": (F.lit(0) if block is None else block).cast("bigint"), "source_row": row.cast("bigint")})
    return placed.withColumn("source_place", place_of(F.col("source_file"), given).cast("int"))


def row_in_task() -> Column:
    """Number of a row among those that its task scans. Rows of one block are scanned in order by one task, whatever else it scans."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path: it changes when they do."""
    hadoop, system = _path(spark, path)
    each, found = system.listFiles(hadoop, True), []
    while each.hasNext():
        status = each.next()
        found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _path(spark, path)
    return system.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop, system = _path(spark, path)
    system.delete(hadoop, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    (a, system), (b, _) = _path(spark, source), _path(spark, target)
    system.mkdirs(b.getParent())
    if not system.rename(a, b):
        raise OSError(f"Could not move {source} to {target}")


def _sibling(target: str, kind: str) -> str:
    stem, _, name = target.rstrip("/").rpartition("/")
    return f"{stem}/_{name}.{kind}-{uuid.uuid4().hex}" if stem or target.startswith("/") else f"_{name}.{kind}-{uuid.uuid4().hex}"


@contextmanager
def staged(spark: SparkSession, target: str, mode: str = "errorifexists") -> Iterator[str]:
    """A folder beside ``target`` to write to and check. It takes the target's place when the block ends, and is removed if the block fails.

    An existing target is refused before any work, or, with ``overwrite``, stays as it is until the new one is whole; if the last move
    fails it is put back. Moves are whole on file systems that rename folders in one step.
    """
    if mode not in MODES:
        raise ValueError(f"The mode is one of {MODES}")
    if mode == "errorifexists" and exists(spark, target):
        raise FileExistsError(f"{target} already exists")
    beside = _sibling(target, "staged")
    try:
        yield beside
        _replace(spark, beside, target, mode)
    except BaseException:
        remove(spark, beside)
        raise


def _replace(spark: SparkSession, beside: str, target: str, mode: str) -> None:
    if not exists(spark, target):
        move(spark, beside, target)
        return
    if mode != "overwrite":  # someone else has written it meanwhile
        raise FileExistsError(f"{target} already exists")
    old = _sibling(target, "old")
    move(spark, target, old)
    try:
        move(spark, beside, target)
    except BaseException:
        move(spark, old, target)
        raise
    remove(spark, old)
