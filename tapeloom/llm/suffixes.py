"""Removal of repeated byte strings by a distributed merge sort of suffixes that never compares a known prefix again.

Suffixes are sorted at anchors only. The anchor of a string of ``LENGTH`` bytes is its leftmost ``GRAM``-byte part of least
hash, so equal strings have equal anchors at the same offset, and neighbouring strings share theirs. Anchors whose
part occurs once in the corpus are left out after an exchange of 32-bit keys. For the others each chunk sorts the
suffixes that start at them, front-codes the sorted run (length of the prefix shared with the one before, and the rest) and
sends it off with the few bytes before each anchor. A bucket, which has all suffixes with the same first ``GRAM`` bytes, merges
its runs with a loser tree on common prefix lengths. Then a string at offset ``o`` before an anchor is repeated if and only
if another anchor agrees in the ``o`` bytes before and the ``LENGTH - o`` bytes after it: both follow from the common
prefix lengths in suffix order and in the order of the texts before, without any hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answer, buckets_of, chunked, pack, parts_of, repeated, send, send_again, short, steps, together, unpack, whole
from .scan import BLOCK, PLAIN, byte_values, mix, powers, text_bytes

LENGTH, GRAM = 200, 73
#: Offsets that an anchor can have in a string.
SPREAD = LENGTH - GRAM + 1

_GRAMS, _RUNS = 0, 1
_PLACE, _ANEW = np.uint64((1 << 20) - 1), np.uint64(0xC3A5C85C97CB3127)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by least values from block starts and to block ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of a chunk: ``at``, the hash of their first bytes, and the strings from ``lo`` to ``hi`` that they stand for."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = text_bytes(table.column("text"))
        values, parts = byte_values(PLAIN.tobytes(), 7), []
        for begin in range(0, max(0, len(self.data) - LENGTH + 1), BLOCK):
            end = min(begin + BLOCK, len(self.data) - LENGTH + 1)
            parts.append(self._block(values, begin, end))
        columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * 3 + [[np.zeros(0, np.uint64)]]
        self.at, self.lo, self.hi, self.gram = (np.concatenate(list(x)) for x in columns)

    def _block(self, values: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
        block = self.data[begin : end + LENGTH - 1]
        up, down = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * up[: len(block)], out=sums[1:])
        n = len(block) - GRAM + 1
        gram = mix((sums[GRAM:] - sums[:n]) * down[:n])
        least = _least((gram & ~_PLACE) | np.arange(n, dtype=np.uint64), SPREAD)
        place = (least & _PLACE).astype(np.int64)
        start = np.arange(begin, end)
        row = np.searchsorted(self.offsets, start[:1], "right")[0] - 1 if len(start) else 0
        ok = np.ones(len(start), bool)
        cuts = []
        # Strings never cross rows: those that start in the last bytes of a row are none.
        for r in range(row, len(self.offsets) - 1):
            stop = self.offsets[r + 1]
            if self.offsets[r] >= end:
                break
            ok[max(0, stop - LENGTH + 1 - begin) : max(0, stop - begin)] = False
            cuts.append(stop - begin)
        first = np.ones(len(start), bool)
        first[1:] = place[1:] != place[:-1]
        cuts = np.array([c for c in cuts if 0 < c < len(start)], np.int64)
        first[cuts] = True
        group = np.flatnonzero(first)
        last = np.append(group[1:], len(start)) - 1
        # The valid strings of a row come first, so a group is cut at its end only.
        good = np.concatenate([[0], np.cumsum(ok)])
        count = good[last + 1] - good[group]
        keep = count > 0
        lo = start[group[keep]]
        # The least hashes crowd at the low end of the key space, so they are mixed anew before they choose a bucket.
        return place[group[keep]] + begin, lo, lo + count[keep] - 1, mix(gram[place[group[keep]]] ^ _ANEW)

    def ask_grams(self, buckets: int) -> list[tuple[int, int, bytes]]:
        _, once = np.unique(self.at, return_index=True)
        keys, counts = np.unique(self.gram[once], return_counts=True)
        return [(b, _GRAMS, pack(steps(short(keys[p], b, buckets)), np.packbits(counts[p] > 1))) for b, p in parts_of(keys, buckets)]

    def records(self, found: dict, buckets: int) -> tuple[dict[int, list[tuple[bytes, bytes]]], dict[int, np.ndarray], dict[int, list[int]]]:
        """Per bucket: distinct (text from the anchor, text before it) in order, the anchors with their number there, counts."""
        keys = np.unique(self.gram)
        again, bucket = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for b, p in parts_of(keys, buckets):
            again[p] = np.unpackbits(np.frombuffer(found[_GRAMS, b], np.uint8), count=p.stop - p.start)
            bucket[p] = b
        key = np.searchsorted(keys, self.gram)
        chosen = np.flatnonzero(again[key])
        raw = self.data.tobytes()
        seen: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
        for i, b, a, lo, hi in zip(chosen.tolist(), bucket[key[chosen]].tolist(), self.at[chosen].tolist(), self.lo[chosen].tolist(), self.hi[chosen].tolist(), strict=True):
            seen.setdefault(b, {}).setdefault((raw[a : hi + LENGTH], raw[lo:a]), []).append(i)
        ordered = {b: sorted(own) for b, own in seen.items()}
        members = {b: [seen[b][r] for r in ordered[b]] for b in ordered}
        which = {b: np.array([(i, k) for k, own in enumerate(members[b]) for i in own], np.int64).reshape(-1, 2) for b in ordered}
        return ordered, which, {b: [len(own) for own in members[b]] for b in ordered}


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    end = min(len(a), len(b))
    while known < end:
        step = min(64, end - known)
        differ = int.from_bytes(a[known : known + step], "big") ^ int.from_bytes(b[known : known + step], "big")
        if differ:
            return known + step - (differ.bit_length() + 7) // 8
        known += step
    return end


def front_coded(ordered: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Common prefix lengths with the string before, and what follows them."""
    shared, rest, before = [], [], b""
    for s in ordered:
        n = common(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return np.array(shared, np.uint8), b"".join(rest)


def decoded(shared: list[int], lengths: list[int], rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n, length in zip(shared, lengths, strict=True):
        before = before[:n] + rest[at : at + length - n]
        at += length - n
        out.append(before)
    return out


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: the run of each string in order, and its common prefix length with the string before.

    A loser tree whose nodes keep, with the loser, how much it has in common with the last winner. Only when two strings
    have equally much in common with it are bytes read, and only those behind that.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    current: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - count)
    known = [0 if c is not None else -1 for c in current]
    place = [0] * size
    loser = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one with the winner, unless bytes were not read."""
        hx, hy = known[x], known[y]
        if hx > hy:
            return x, y
        if hx < hy:
            return y, x
        if hx < 0:
            return x, y
        a, b = current[x], current[y]
        n = common(a, b, hx)
        if n == len(a) or n < len(b) and a[n] < b[n]:
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return winner

    winner = build(1) if size > 1 else 0
    order, lengths = [], []
    while known[winner] >= 0:
        order.append(winner)
        lengths.append(known[winner])
        k = place[winner] + 1
        place[winner] = k
        run = runs[winner]
        if k < len(run):
            current[winner], known[winner] = run[k], shared[winner][k]
        else:
            current[winner], known[winner] = None, -1
        node = (winner + size) >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1
    return order, lengths


def repeated_offsets(after: list[bytes], lengths: np.ndarray, before: list[bytes], many: np.ndarray) -> np.ndarray:
    """For each suffix in order and each offset whether the string at that offset before its anchor is repeated.

    ``lengths`` are common prefix lengths with the suffix before; ``before`` are the texts before the anchors; ``many``
    marks suffixes that stand for several equal places.
    """
    n = len(after)
    most = np.array([len(x) for x in before], np.int64)
    least = LENGTH - np.array([len(x) for x in after], np.int64)
    mirrored = [x[::-1] for x in before]
    by_left = sorted(range(n), key=mirrored.__getitem__)
    left = np.zeros(n, np.int64)
    left[1:] = [common(mirrored[i], mirrored[j]) for i, j in zip(by_left[:-1], by_left[1:], strict=True)]
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    out = np.zeros((n, SPREAD), bool)
    for o in range(SPREAD):
        own = np.flatnonzero((least <= o) & (o <= most))
        if not len(own):
            continue
        # Strings that agree in so many bytes are neighbours in order, so a class is a stretch without a smaller length.
        right_class = np.cumsum(lengths < LENGTH - o)[own]
        left_class = np.cumsum(left < o)[rank[own]] if o else 0
        key = right_class * n + left_class
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = many[own]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out[own, o] = again
    return out


def _ask_runs(anchors: Anchors, found: dict, buckets: int) -> list[tuple[int, int, bytes]]:
    ordered, _, counts = anchors.records(found, buckets)
    out = []
    for b, records in ordered.items():
        after, before = [r[0] for r in records], [r[1] for r in records]
        shared, rest = front_coded(after)
        sizes = [np.array([len(x) for x in side], np.uint8) for side in (after, before)]
        many = np.packbits(np.array(counts[b]) > 1)
        out.append((b, _RUNS, pack(shared, *sizes, many, np.frombuffer(rest, np.uint8), np.frombuffer(b"".join(before), np.uint8))))
    return out


def _reply_grams(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
    sent = [(chunk, *unpack(payload, "<u4", "u1")) for chunk, payload in got.get(_GRAMS, [])]
    sent = [(chunk, whole(keys), bits) for chunk, keys, bits in sent]
    marks = repeated([k for _, k, _ in sent], [np.unpackbits(bits, count=len(k)) for _, k, bits in sent])
    return [(chunk, _GRAMS, np.packbits(x).tobytes()) for (chunk, _, _), x in zip(sent, marks, strict=True)]


def _reply_runs(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
    chunks, runs, shared, before, many = [], [], [], [], []
    for chunk, payload in got.get(_RUNS, []):
        known, sizes, left_sizes, bits, rest, lefts = unpack(payload, "u1", "u1", "u1", "u1", "u1", "u1")
        chunks.append(chunk)
        shared.append(known.tolist())
        runs.append(decoded(shared[-1], sizes.tolist(), rest.tobytes()))
        raw, ends = lefts.tobytes(), np.cumsum(left_sizes.astype(np.int64)).tolist()
        before.append([raw[e - n : e] for e, n in zip(ends, left_sizes.tolist(), strict=True)])
        many.append(np.unpackbits(bits, count=len(sizes)).astype(bool))
    if not chunks:
        return []
    order, lengths = merge(runs, shared)
    run = np.array(order, np.int64)
    # The next string of a run is the next of its place in the merged order.
    nth = np.empty(len(run), np.int64)
    for r in range(len(runs)):
        nth[run == r] = np.arange(len(runs[r]))
    after = [runs[r][k] for r, k in zip(order, nth.tolist(), strict=True)]
    left = [before[r][k] for r, k in zip(order, nth.tolist(), strict=True)]
    marks = repeated_offsets(after, np.array(lengths, np.int64), left, np.array([many[r][k] for r, k in zip(order, nth.tolist(), strict=True)], bool))
    return [(chunk, _RUNS, np.packbits(marks[run == r], axis=1).tobytes()) for r, chunk in enumerate(chunks)]


def spans_of(anchors: Anchors, found: dict, buckets: int) -> list[np.ndarray]:
    """For each row the removed spans as pairs of byte places within the chunk, ordered and apart."""
    _, which, _ = anchors.records(found, buckets)
    starts = []
    for b, pairs in which.items():
        marks = np.unpackbits(np.frombuffer(found[_RUNS, b], np.uint8)).reshape(-1, SPREAD)[pairs[:, 1]]
        anchor, offset = np.nonzero(marks)
        starts.append(anchors.at[pairs[anchor, 0]] - offset)
    start = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    row = np.searchsorted(anchors.offsets, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) > LENGTH) | (np.diff(row) > 0)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1 if len(start) else begin
    spans = np.stack([start[begin], start[last] + LENGTH], 1) if len(start) else np.zeros((0, 2), np.int64)
    bounds = np.searchsorted(row[begin], np.arange(len(anchors.offsets)))
    return [spans[bounds[r] : bounds[r + 1]] for r in range(len(anchors.offsets) - 1)]


def whole_characters(data: np.ndarray, spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans narrowed to whole characters, so that what is left is valid UTF-8."""
    out = []
    for s, e in spans.tolist():
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", bytewise: bool = True, **carried) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` and the ``carried`` columns, one row for each of ``docs``.

    Every byte goes that a string of 200 bytes covers which starts anywhere else too; all its places lose it. With
    ``bytewise`` the rest is binary; without, a character goes only as a whole and the rest is text, null for a null.
    Null texts have no bytes, shorter texts than 200 bytes lose none, repeated rows lose each other's strings.
    """
    spark = docs.sparkSession
    landed = chunked(docs, doc_id=F.col(id).cast("long"), text=F.col(text), **carried)
    buckets = buckets_of(spark)
    grams = answer(send(landed, lambda _, t: Anchors(t).ask_grams(buckets), ("text",)), _reply_grams)
    runs = answer(send_again(landed, grams, lambda _, t, found: _ask_runs(Anchors(t), found, buckets), ("text",)), _reply_runs)
    kind, names = "binary" if bytewise else "string", tuple(carried)
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}" + "".join(f", `{n}` {landed.schema[n].dataType.simpleString()}" for n in carried)

    def keep(_, table: pa.Table, found: dict) -> pa.Table:
        anchors = Anchors(table)
        raw, offsets = anchors.data.tobytes(), anchors.offsets.tolist()
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        missing = table.column("text").is_null().to_pylist()
        for r, spans in enumerate(spans_of(anchors, found, buckets)):
            pairs = spans.tolist() if bytewise else whole_characters(anchors.data, spans)
            at, parts = offsets[r], []
            for s, e in pairs:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at : offsets[r + 1]])
            left = b"".join(parts)
            n_bytes.append(offsets[r + 1] - offsets[r])
            n_removed.append(n_bytes[-1] - len(left))
            n_spans.append(len(pairs))
            kept.append(left if bytewise else None if missing[r] else left.decode())
        numbers = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
        return pa.Table.from_arrays([table.column("doc_id"), *numbers, pa.array(kept, pa.binary() if bytewise else pa.string()), *(table.column(n) for n in names)],
                                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *names])

    return together(landed, grams.unionByName(runs), keep, schema, ("text", *carried))


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the digest of the bytes that are left."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
