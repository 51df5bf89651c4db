"""Removal of repeated passages of words, found by difference-cover anchors.

Every third or so of the positions of a text is in a difference cover modulo the period: for any two places at which a
passage of ``LENGTH`` words stands there is one step, below the period, that takes both to cover positions. So both have
an anchor, a hashed run of ``LENGTH - PERIOD + 1`` words, at the same place of the passage, and only anchors are exchanged at
first, as 32-bit keys. Around anchors that occur again windows are extended to their full length and compared by 96 bits.
No pair is formed: a window asks whether its words start earlier anywhere, and a chunk asks once for equal windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answer, buckets_of, chunked, pack, parts_of, repeated, send, send_again, short, steps, together, unpack, whole
from .scan import SPACED, Words, contains, covered, scan, sequence_hash, text_bytes, window_starts

LENGTH = 20
#: A difference cover: each remainder modulo the period is the difference of two members.
PERIOD, COVER = 7, (0, 1, 3)

_ANCHOR, _WINDOW = 0, 1
_LAST = np.iinfo(np.int64).max


class Chunk:
    """Words, anchors and windows of one chunk."""

    def __init__(self, table: pa.Table, length: int):
        self.data, self.offsets = text_bytes(table.column("text"))
        self.words: Words = scan(self.data, self.offsets, SPACED)
        self.length, self.size = length, length - PERIOD + 1
        self.doc = table.column("doc_id").fill_null(_LAST).to_numpy() if table.num_rows else np.zeros(0, np.int64)
        hashed = sequence_hash(self.words.hash, self.size)
        place = np.arange(len(hashed)) - np.repeat(self.words.first[:-1], self.words.per_row)[: len(hashed)]
        at = window_starts(self.words, self.size) & np.isin(place % PERIOD, COVER)
        self.at = np.flatnonzero(at)
        self.anchor = hashed[self.at]

    def anchors(self, buckets: int) -> list[tuple[int, int, bytes]]:
        """The chunk's distinct anchors, marked if they occur more than once in it."""
        keys, counts = np.unique(self.anchor, return_counts=True)
        return [(b, _ANCHOR, pack(steps(short(keys[p], b, buckets)), np.packbits(counts[p] > 1))) for b, p in parts_of(keys, buckets)]

    def candidates(self, found: dict, buckets: int) -> np.ndarray:
        """Starts of windows that hold an anchor which occurs again, early enough to be the shared one."""
        keys = np.unique(self.anchor)
        again = np.zeros(len(keys), bool)
        for b, p in parts_of(keys, buckets):
            again[p] = np.unpackbits(np.frombuffer(found[_ANCHOR, b], np.uint8), count=p.stop - p.start)
        marked = self.at[contains(self.anchor, keys[again])]
        ok = window_starts(self.words, self.length)
        near = np.zeros(len(ok) + PERIOD, bool)
        near[marked[marked < len(near)]] = True
        reach = np.concatenate([[0], np.cumsum(near)])
        return np.flatnonzero(ok & (reach[PERIOD : PERIOD + len(ok)] > reach[: len(ok)]))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct window hashes, the first start of each, and for every start the number of its hash."""
        hashed = sequence_hash(self.words.hash, self.length)[starts]
        keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        return keys, starts[first], which

    def ask_windows(self, starts: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
        keys, first, _ = self.windows(starts)
        check = (sequence_hash(self.words.hash, self.length, seed=1)[first] >> np.uint64(32)).astype(np.uint32)
        doc = self.doc[np.searchsorted(self.words.first, first, "right") - 1]
        return [(b, _WINDOW, pack(steps(keys[p]), check[p], doc[p])) for b, p in parts_of(keys, buckets)]

    def removed(self, found: dict, buckets: int) -> np.ndarray:
        """Marks words that a window covers whose words start earlier."""
        starts = self.candidates(found, buckets)
        keys, first, which = self.windows(starts)
        earlier = np.zeros(len(keys), bool)
        for b, p in parts_of(keys, buckets):
            earlier[p] = np.unpackbits(np.frombuffer(found[_WINDOW, b], np.uint8), count=p.stop - p.start)
        gone = starts[earlier[which] | (first[which] != starts)]
        return covered(gone, self.length, len(self.words))


def _reply_anchors(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
    chunks, lists, flags = [], [], []
    for chunk, payload in got.get(_ANCHOR, []):
        keys, bits = unpack(payload, "<u4", "u1")
        chunks.append(chunk)
        lists.append(whole(keys))
        flags.append(np.unpackbits(bits, count=len(keys)))
    return [(c, _ANCHOR, np.packbits(x).tobytes()) for c, x in zip(chunks, repeated(lists, flags), strict=True)]


def _reply_windows(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
    """For each chunk's windows whether another chunk has an equal one in a smaller document."""
    sent = [(chunk, *unpack(payload, "<u8", "<u4", "<i8")) for chunk, payload in got.get(_WINDOW, [])]
    sent = [(chunk, whole(key), check, doc) for chunk, key, check, doc in sent]
    if not sent:
        return []
    key, check, doc = (np.concatenate([x[i] for x in sent]) for i in (1, 2, 3))
    whose = np.repeat(np.arange(len(sent)), [len(x[1]) for x in sent])
    order = np.lexsort((whose, doc, check, key))
    later = np.zeros(len(key), bool)
    later[order[1:]] = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
    return [(sent[i][0], _WINDOW, np.packbits(later[whose == i]).tobytes()) for i in range(len(sent))]


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words of each text, without passages that start earlier, joined by spaces.

    Earlier means in a smaller id, or in the same document before. A null text has no words; rows without an id come last;
    rows of one id stand in the order in which they are read. Judged on the input, so a removed passage still counts as earlier.
    """
    landed = chunked(docs, doc_id=F.col(id).cast("long"), text=F.col(text))
    buckets = buckets_of(docs.sparkSession)
    anchors = answer(send(landed, lambda _, t: Chunk(t, length).anchors(buckets), ("text",)), _reply_anchors)

    def ask(_, table, found):
        chunk = Chunk(table, length)
        return chunk.ask_windows(chunk.candidates(found, buckets), buckets)

    windows = answer(send_again(landed, anchors, ask, ("text",)), _reply_windows)

    def keep(_, table: pa.Table, found: dict) -> pa.Table:
        chunk = Chunk(table, length)
        words, gone = chunk.words, chunk.removed(found, buckets)
        raw, kept = chunk.data.tobytes(), []
        for r in range(table.num_rows):
            lo, hi = words.first[r], words.first[r + 1]
            stay = np.flatnonzero(~gone[lo:hi]) + lo
            kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode())
        n_words = words.per_row
        n_removed = [int(gone[lo:hi].sum()) for lo, hi in zip(words.first[:-1], words.first[1:], strict=True)]
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return together(landed, anchors.unionByName(windows), keep, "doc_id long, n_words long, n_removed long, kept string", ("text",))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document with the digest of what is kept."""
    return deduplicated(docs, length=length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
