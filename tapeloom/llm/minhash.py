"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

Every element of a weighted set owns one region of the plane of weight and rank: its weight wide, without end in rank. Darts
fall on regions as a Poisson process that is a function of the element and the weight unit alone, so equal parts
of two sets get equal darts. A dart belongs to one coordinate of the signature, and each coordinate keeps its
earliest dart. Darts are thrown for all of a document's elements up to the rank at which every coordinate expects several, so
the work is in proportion to the elements plus the darts, whatever the length of the signature.

Documents with equal sets are folded first. Band keys are counted before they are joined: a small group of a band gives
all its pairs, a larger one a star around its least member and is cut finer by the next band's key. Candidate pairs are
checked on their whole texts, and classes are the components of the links, found by star contraction. A larger group whose members
are not in one component by then is searched whole: first inside random blocks, then, if that leaves several components, every
block of members outside the largest component against every other block. The overlaps of all pairs of a block are
counted exactly, so that two members of a group that are similar enough are always in one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import land
from .chunks import chunked, picked
from .scan import SPACED, mix, scan, sequence_hash, slices, text_bytes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Groups of a band up to this size give all their pairs.
SMALL = 12
#: Texts stay where they are landed, in chunks of at most so many bytes and rows.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4096
#: A block of a larger group has about so many members and shingles at most.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Shingles of at most so many members of a block are counted pair by pair, others by products of matrices.
RARE, COLUMNS = 12, 4096

_UNIT, _THROW = np.uint64(0xA24BAED4963EE407), 0x9FB21C651E98DF25


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, how often each stands in its row, and the row, in order. Fewer than ``n`` words are one shingle."""
    words = scan(data, offsets, SPACED)
    count, row, m = words.per_row, words.row, max(0, len(words) - n + 1)
    whole = sequence_hash(words.hash, n)[np.arange(m) + n <= words.limit()[:m]]
    rows = row[:m][np.arange(m) + n <= words.limit()[:m]]
    few = np.flatnonzero((count > 0) & (count < n))
    short = [sequence_hash(words.hash[words.first[r] : words.first[r + 1]], int(count[r])) for r in few.tolist()]
    value, rows = np.concatenate([whole, *short]), np.concatenate([rows, few])
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return value[at], np.diff(np.append(at, len(value))), rows[at]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, k: int = COORDINATES) -> np.ndarray:
    """Signature of each row's weighted set: for every coordinate the earliest dart, as 64 bits; zeros for an empty set."""
    out = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    units = np.ceil(weight).astype(np.int64)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    cell = mix(np.repeat(element, units) + unit.astype(np.uint64) * _UNIT)
    part = np.minimum(np.repeat(weight, units) - unit, 1.0)
    owner = np.repeat(row, units)
    todo = total > 0
    reach = np.zeros(rows)
    reach[todo] = k * (math.log(k) + 3) / total[todo]
    while todo.any():
        live = np.flatnonzero(todo[owner])
        rank, turn, darts = np.zeros(len(live)), 0, []
        while len(live):
            turn += 1
            dart = mix(cell[live] + np.uint64(turn * _THROW & (1 << 64) - 1))
            rank = rank - np.log(_uniform(dart))
            near = rank <= reach[owner[live]]
            live, rank, dart = live[near], rank[near], dart[near]
            name = mix(dart)
            hit = _uniform(mix(name)) <= part[live]  # the dart's place across the weight
            darts.append((owner[live][hit], (name % np.uint64(k)).astype(np.int64)[hit], rank[hit], name[hit]))
        whose, coordinate, rank, name = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.lexsort((name, rank, coordinate, whose))
        slot = whose[order] * k + coordinate[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        full = np.bincount(whose[order][first], minlength=rows) == k
        done = first & full[whose[order]]
        out.reshape(-1)[slot[done]] = name[order][done]
        todo &= ~full
        reach *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    total = np.zeros((len(signature), bands), np.uint64)
    for j in range(per):
        total = mix(total + signature[:, j::per][:, :bands] + np.uint64(j + 1))
    return total.view(np.int64)


def described(named: DataFrame, weighted: bool) -> DataFrame:
    """``rid, id__, set_key, size, bands`` of every row; the key is null for a text without words."""
    def describe(batches):
        for batch in (s for b in batches for s in slices(b, "text")):
            rows = batch.num_rows
            value, often, row = shingles(*text_bytes(batch.column("text")))
            weight = often.astype(np.float64) if weighted else np.ones(len(value))
            bands = band_keys(signatures(value, weight, row, rows))
            size = np.bincount(row, weights=weight, minlength=rows).astype(np.int64)
            ends = np.searchsorted(row, np.arange(rows + 1))
            salted = mix(value * np.uint64(3) + weight.astype(np.uint64)), mix(value ^ np.uint64(0x5DEECE66D) ^ (weight.astype(np.uint64) << np.uint64(40)))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in salted]
            key = np.stack([s[ends[1:]] - s[ends[:-1]] for s in sums], 1).copy()
            keys = [key[r].tobytes() if size[r] else None for r in range(rows)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id__"), pa.array(keys, pa.binary()), pa.array(size), listed], ["rid", "id__", "set_key", "size", "bands"])

    return named.mapInArrow(describe, "rid long, id__ long, set_key binary, size long, bands array<long>")


def candidate_pairs(reps: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of representatives that share a band key, with sizes that allow the similarity, and the members
    (``band, key, rep, size, members``) of the groups that were too large to give all their pairs."""
    bands = reps.select("rep", "size", F.posexplode("bands").alias("band", "key"), F.col("bands"))
    rows = bands.select("rep", "size", "band", "key", F.get("bands", F.pmod(F.col("band") + 1, F.lit(BANDS))).alias("finer"))
    one = F.struct("rep", "size")

    def counted(df: DataFrame, *by: str) -> DataFrame:
        groups = df.groupBy(*by).agg(F.count("*").alias("members"), F.min(one).alias("least")).where("members > 1")
        return df.join(groups, list(by))

    def inside(df: DataFrame, *by: str) -> DataFrame:
        listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("own"))
        first = listed.select("own", F.posexplode("own").alias("i", "x"))
        return first.select("x", F.explode(F.slice("own", F.col("i") + 2, F.lit(SMALL))).alias("y"))

    def star(df: DataFrame) -> DataFrame:
        return df.where(F.col("rep") != F.col("least.rep")).select(F.col("least").alias("x"), one.alias("y"))

    level = land(counted(rows, "band", "key"), "bands")
    large = counted(level.where(F.col("members") > SMALL).drop("members", "least"), "band", "key", "finer")
    pairs = (
        inside(level.where(F.col("members") <= SMALL), "band", "key")
        .unionByName(star(level.where(F.col("members") > SMALL)))
        .unionByName(inside(large.where(F.col("members") <= SMALL), "band", "key", "finer"))
        .unionByName(star(large.where(F.col("members") > SMALL)))
    )
    sizes = F.least("x.size", "y.size") >= F.lit(similar) * F.greatest("x.size", "y.size")
    found = pairs.where(sizes).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    return found, level.where(F.col("members") > SMALL).select("band", "key", "rep", "size", "members")


def unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the large groups that have several components, with the ``root`` of each, the group's members ``n`` and
    shingles ``s``, and those of its largest component ``main``."""
    members = large.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = members.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    groups = parts.groupBy("band", "key").agg(F.max(F.struct("n", "root", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts"))
    return members.join(groups.where("parts > 1").drop("parts"), ["band", "key"])


def _blocks(n: F.Column, s: F.Column) -> F.Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES))


def single_blocks(members: DataFrame) -> DataFrame:
    """``block, rep, root``: every member in one random block of its group. A block is a key of its own, so that a large group's
    are dealt to all tasks."""
    place = F.pmod(F.xxhash64("rep", "band"), _blocks(F.col("n"), F.col("s")))
    return members.select(F.xxhash64("band", "key", place).alias("block"), "rep", "root")


def paired_blocks(members: DataFrame) -> DataFrame:
    """``block, rep, root``: every pair of blocks of a group of which one at least is outside its largest component, so that all
    pairs of members with different roots meet."""
    outside = F.col("root") != F.col("main.root")
    rest, main = _blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")), _blocks(F.col("main.n"), F.col("main.s"))
    place = F.xxhash64("rep", "band", F.lit(1))
    own = F.when(outside, F.pmod(place, rest)).otherwise(rest + F.pmod(place, main))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, rest + main).otherwise(rest) - 1))
    spread = members.where(_blocks(F.col("n"), F.col("s")) > 1).select("band", "key", "rep", "root", own.alias("own"), other.alias("other"))
    return spread.where("own <> other").select(F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "rep", "root")


def overlaps(element: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many elements every two rows share, exactly; the entries above the diagonal count. Elements of a row are distinct."""
    order = np.lexsort((row, element))
    element, row = element[order], row[order]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    column, often = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(element)))
    shared = np.zeros(rows * rows)
    few = often[column] <= RARE
    c, r = column[few], row[few]
    for d in range(1, RARE):
        same = c[d:] == c[:-d]
        if not same.any():
            break
        shared += np.bincount(r[:-d][same] * rows + r[d:][same], minlength=rows * rows)
    shared = shared.reshape(rows, rows)
    column, row = np.unique(column[~few], return_inverse=True)[1], row[~few]
    ends = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        has = np.zeros((rows, COLUMNS), np.float32)
        has[row[a:b], column[a:b] - k * COLUMNS] = 1
        shared += has @ has.T
    return shared


def joining(blocks: DataFrame, texts: DataFrame, similar: float, weighted: bool) -> DataFrame:
    """Links ``a < b`` that join the components of each block's members: all pairs of a block are compared on their whole texts."""
    texts = picked(texts, blocks.select(F.col("rep").alias("rid")))
    both = blocks.join(texts.select(F.col("rid").alias("rep"), "text"), "rep").select("block", "rep", "root", "text")

    def compare(table):
        table = table.sort_by("rep")
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        value, often, row = shingles(*text_bytes(table.column("text")))
        if weighted:  # the second of two equal shingles is an element of its own
            nth = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
            value, row = mix(np.repeat(value, often) + nth.astype(np.uint64) * _UNIT), np.repeat(row, often)
        n = len(rep)
        size = np.bincount(row, minlength=n)
        shared = overlaps(value, row, n)
        linked = np.triu((shared >= similar * (size[:, None] + size - shared)) & (root[:, None] != root), 1)
        head, out = {}, []

        def find(x):
            while (up := head.get(x, x)) != x:
                head[x] = head.get(up, up)
                x = up
            return x

        for i, j in np.argwhere(linked).tolist():
            x, y = find(root[i]), find(root[j])
            if x != y:
                head[max(x, y)] = min(x, y)
                out.append((rep[i], rep[j]))
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return both.groupBy("block").applyInArrow(compare, "a long, b long").distinct()


def links(pairs: DataFrame, texts: DataFrame, similar: float, weighted: bool) -> DataFrame:
    """The pairs whose whole texts have a similarity of at least ``similar``."""
    # Only texts that are in a pair are dealt out. A star's centre is always ``a``; its pairs are checked where their ``b`` is.
    texts = picked(texts, pairs.select(F.explode(F.array("a", "b")).alias("rid")))
    left, right = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        for batch in (s for b in batches for s in slices(b, "text_b")):
            for small in slices(batch, "text_a"):
                sides = []
                for c in ("text_a", "text_b"):
                    value, often, row = shingles(*text_bytes(small.column(c)))
                    sides.append((value, often if weighted else np.ones(len(value), np.int64), np.searchsorted(row, np.arange(small.num_rows + 1))))
                keep = []
                for r in range(small.num_rows):
                    (va, na), (vb, nb) = (((v[e[r] : e[r + 1]], n[e[r] : e[r + 1]])) for v, n, e in sides)
                    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                    shared = int(np.minimum(na[i], nb[j]).sum())
                    keep.append(shared >= similar * (int(na.sum()) + int(nb.sum()) - shared))
                yield pa.RecordBatch.from_arrays([small.column("a"), small.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component of every node that has a link.

    Alternates large stars (each larger neighbour to the least neighbour) and small stars, landing every round, until the
    links stay the same; all of them are stars around roots then.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = land(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
    before = None
    while (state := mark(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = land(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _held(docs: DataFrame, text: str) -> dict[str, str]:
    """Names that the columns of ``docs`` have in the landed table, where they clash with no others."""
    return {c: "text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)}


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs`` landed in chunks with a row number ``rid`` and columns named by ``_held``, and per ``rid`` its class.

    The second table has ``rid, id, class_id`` (least id of the class), ``keep`` (one row of each class) and ``n_links`` (checked links of
    the row's set to different sets; in a larger group those that join its class, not all that there are). Rows whose shingle sets are equal are one class without being paired; texts without words,
    null ones too, are alone, each its own class. Ties of ids are broken by the order of reading; a null id comes last.
    ``weighted`` counts a shingle as often as it occurs.
    """
    held = {name: F.col(f"`{c}`") for c, name in _held(docs, text).items()}
    landed = chunked(docs, CHUNK_BYTES, CHUNK_ROWS, **{"doc_id": F.col(f"`{id}`").cast("long"), **held})
    facts = land(described(landed.select("rid", F.col("doc_id").alias("id__"), "text"), weighted), "sets")
    order = F.struct(F.col("id__").isNull().alias("n"), F.col("id__").alias("i"), F.col("rid").alias("r"))
    sets = facts.where("set_key is not null").groupBy("set_key").agg(F.min("rid").alias("rep"), F.min(order).alias("least"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    sets = land(sets, "representatives")
    texts = landed.select("chunk", "rid", "text")
    pairs, large = candidate_pairs(sets, similar)
    found = land(links(land(pairs, "pairs"), texts, similar, weighted), "edges")
    roots = components(found)
    for dealt in (single_blocks, paired_blocks):
        blocks = land(dealt(unsettled(large, roots)), "blocks")
        if blocks.isEmpty():
            continue
        more = land(joining(blocks, texts, similar, weighted), "edges")
        if not more.isEmpty():
            found = found.unionByName(more)
            roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    labelled = sets.select("set_key", F.col("rep").alias("node"), "least").join(roots, "node", "left").join(degree, "node", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    heads = labelled.groupBy("root").agg(F.min("least").alias("head"))
    by_set = labelled.join(heads, "root").select("set_key", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    result = facts.select("rid", "id__", "set_key").join(by_set, "set_key", "left")
    alone = F.col("head").isNull()
    return landed, result.select(
        "rid", F.col("id__").alias("id"), F.when(alone, F.col("id__")).otherwise(F.col("head.i")).alias("class_id"),
        (alone | (F.col("head.r") == F.col("rid"))).alias("keep"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def clean_rows(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns of ``docs``."""
    landed, found = classes(docs, text=text, **options)
    kept = picked(landed, found.where("keep").select("rid"))
    return kept.select(*[F.col(name).alias(c) for c, name in _held(docs, text).items()])


def report(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """One row per document: its class, whether it is the one that stays, and its set's links to different sets."""
    found = classes(docs.select("doc_id", "text"), weighted=weighted)[1]
    return found.select(F.col("id").alias("doc_id"), "class_id", "keep", "n_links")
