"""Texts landed in chunks, and exchanges of packed arrays between chunks and buckets.

Several operators ask of every document something that only the whole corpus can answer: is this
window anywhere else, how often does this word occur. A chunk is up to a few MB of neighbouring
documents, landed once in a table bucketed by chunk. Each chunk folds its questions to distinct ones,
packs them as one array per bucket of the key space and sends the arrays off; a bucket answers all
chunks; answers return to their chunk beside its documents, whose table is not shuffled again. However
frequent a key is, a bucket gets it at most once per chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import land, shared_dir
from .scan import settle, text_bytes

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: Bits of a row number that tell the rows of a chunk apart; the bits above them are the chunk's number.
PLACE_BITS = 20


def buckets_of(spark: SparkSession) -> int:
    """Parts of the key space: several for each task, so that tasks are even."""
    return 4 * width(spark)


def width(spark: SparkSession) -> int:
    """Partitions of an exchange: what the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunked(docs: DataFrame, nbytes: int | None = None, nrows: int = 1 << PLACE_BITS, **columns) -> DataFrame:
    """Land ``docs`` with a row number ``rid`` and a ``chunk`` number, bucketed by chunk; ``rid`` follows the order of reading.

    ``columns`` maps new names to columns of ``docs``; ``doc_id`` and ``text`` must be among them. Numbers are made
    once and landed, so that tasks that run again after the loss of an executor see the same ones.
    """
    limit = nbytes or CHUNK_BYTES
    spark = docs.sparkSession
    chosen = docs.select(*[c.alias(name) for name, c in columns.items()])
    numbers = [StructField("chunk", LongType()), StructField("rid", LongType())]
    schema = StructType(numbers + [StructField(f.name, f.dataType) for f in chosen.schema])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        part, filled, rows = 0, 0, 0
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column("text"))[1])
            chunk, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for i, size in enumerate(sizes.tolist()):
                if rows == nrows or filled and filled + size > limit:
                    part, filled, rows = part + 1, 0, 0
                chunk[i], place[i] = part, rows
                filled, rows = filled + size, rows + 1
            chunk += task << 20
            rid = (chunk << PLACE_BITS) + place
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(rid), *batch.columns], ["chunk", "rid", *batch.schema.names])

    name = f"tapeloom_chunks_{uuid.uuid4().hex}"
    (
        chosen.mapInArrow(number, schema)
        .write.bucketBy(width(spark), "chunk").sortBy("chunk", "rid")
        .option("path", f"{shared_dir(spark)}/tapeloom/{name}")
        .format("parquet").saveAsTable(name)
    )
    return spark.table(name)


def picked(landed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a landed table whose ``rid`` is in ``ids``. The ids alone are dealt out, as one list for each chunk; the table's rows stay
    in their buckets, however many ids there are."""
    listed = ids.select(F.shiftright("rid", PLACE_BITS).alias("chunk"), "rid").groupBy("chunk").agg(F.collect_set("rid").alias("rids__"))
    return landed.join(listed.hint("shuffle_hash"), "chunk").where(F.array_contains("rids__", F.col("rid"))).drop("rids__")


#: Documents of a chunk are always seen in this order; rows without an id come last.
ORDER = [("doc_id", "ascending"), ("rid", "ascending")]

#: One packed array of a kind, on its way between a chunk and a bucket.
PARCEL = "chunk long, bucket int, kind int, payload binary"
_PARCEL = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def parcels(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARCEL, strict=True)], schema=_PARCEL)


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one value: their number, the items and used bytes of each, then first bytes of all items before second ones.

    A byte that is zero in all items is left out, so small numbers take little room before the exchange's own compression too.
    """
    head, blobs = [len(arrays)], []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((0, 0), np.uint8)
        used = np.flatnonzero(planes.any(axis=1))
        head += [len(a), sum(1 << i for i in used.tolist())]
        blobs.append(planes[used].tobytes())
    return b"".join([np.array(head, "<u8").tobytes(), *blobs])


def unpack(payload: bytes, *kinds: str | np.dtype) -> list[np.ndarray]:
    head = np.frombuffer(payload, "<u8", 2 * len(kinds) + 1)
    at, out = 8 * len(head), []
    for kind, n, mask in zip(kinds, head[1::2].tolist(), head[2::2].tolist(), strict=True):
        items = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        used = [i for i in range(items.shape[1]) if mask >> i & 1]
        items[:, used] = np.frombuffer(payload, np.uint8, n * len(used), at).reshape(len(used), n).T
        out.append(items.view(kind).reshape(-1))
        at += n * len(used)
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ordered unsigned numbers; ``np.cumsum`` with their type gives them back."""
    out = ordered.copy()
    out[1:] -= ordered[:-1]
    return out


def whole(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def split_ordered(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket in ordered 64-bit keys: bucket ``b`` has the keys of the ``b``-th equal part of the key space."""
    step = (1 << 64) // buckets + 1
    edges = np.array([b * step for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def send(docs: DataFrame, ask: Callable[[int, pa.Table], list[tuple]], keep: tuple[str, ...]) -> DataFrame:
    """Parcels of every chunk: ``ask(chunk, table)`` sees all documents of one chunk."""
    def one(key, table):
        chunk = key[0].as_py()
        out = parcels([(chunk, *row) for row in ask(chunk, table.sort_by(ORDER))])
        settle()
        return out

    return docs.select("chunk", "rid", "doc_id", *keep).groupBy("chunk").applyInArrow(one, PARCEL)


def answer(sent: DataFrame, reply: Callable[[int, dict], list[tuple]]) -> DataFrame:
    """Answers of every bucket, landed: ``reply(bucket, {kind: [(chunk, payload), ...]})`` gives (chunk, kind, payload)."""
    def one(key, table):
        got: dict[int, list[tuple[int, bytes]]] = {}
        for chunk, kind, payload in sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "payload")), strict=True)):
            got.setdefault(kind, []).append((chunk, payload))
        bucket = key[0].as_py()
        out = parcels([(chunk, bucket, kind, payload) for chunk, kind, payload in reply(bucket, got)])
        settle()
        return out

    return land(sent.groupBy("bucket").applyInArrow(one, PARCEL), "answers")


def together(docs: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, dict], pa.Table], schema: str, keep: tuple[str, ...]) -> DataFrame:
    """Each chunk with its answers: ``work(chunk, table, {(kind, bucket): payload})``."""
    def one(key, table, got):
        found = dict(zip(zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist(), strict=True), got.column("payload").to_pylist(), strict=True))
        out = work(key[0].as_py(), table.sort_by(ORDER), found)
        settle()
        return out

    left, right = docs.select("chunk", "rid", "doc_id", *keep).groupBy("chunk"), answers.groupBy("chunk")
    return left.cogroup(right).applyInArrow(one, schema)


def send_again(docs: DataFrame, answers: DataFrame, ask: Callable[[int, pa.Table, dict], list[tuple]], keep: tuple[str, ...]) -> DataFrame:
    """Parcels that a chunk sends after it has seen its first answers."""
    def work(chunk: int, table: pa.Table, found: dict) -> pa.Table:
        return parcels([(chunk, *row) for row in ask(chunk, table, found)])

    return together(docs, answers, work, PARCEL, keep)


def repeated(lists: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
    """For ordered lists of distinct keys: which of each list's keys are flagged or in another list too."""
    if not lists:
        return []
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    many = np.zeros(len(keys), bool)
    same = ordered[1:] == ordered[:-1]
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    many |= np.concatenate(flags).astype(bool)
    # A flagged key is repeated wherever it is; keys in two lists are marked in both already.
    return np.split(many, np.cumsum([len(x) for x in lists])[:-1])


def parts_of(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    bounds = split_ordered(keys, buckets)
    for b in range(buckets):
        if bounds[b + 1] > bounds[b]:
            yield b, slice(int(bounds[b]), int(bounds[b + 1]))


def short(keys: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """32 bits of a key that, with its bucket, tell it from others: equal keys agree, others seldom do."""
    step = (1 << 64) // buckets + 1
    within = keys - np.uint64(bucket * step)
    shift = max(0, step.bit_length() - 32)
    return (within >> np.uint64(shift)).astype(np.uint32)
