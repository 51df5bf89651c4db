"""A prefix trie over conversations, grown as a burst trie.

Every distinct turn (role, text) has an id, a conversation is a string of ids, and equal conversations are folded to one. All strings
start in one container under the root. A container whose strings have more turns left than one task should hold bursts: its head becomes
a node of the trie, its strings go to one container for each next turn id, and strings that end there end at the node. So the heads
branch only where data are dense, level by level, until all containers are small. Then each container's strings are sorted and swept
once with a stack into nodes. A container of one string, however long, is a path and needs no sweep: its nodes are its turns.

Heads' figures are sums over the tops of the containers below, added up level by level. Texts never move: they become ids first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import positions, running_totals
from ..runtime import land

#: Turns that a container may have left, if it has more than one string; with more than MOST_HEADS times as many turns in all, the limit
#: grows with the table, so that the heads of one level, which are broadcast, are MOST_HEADS at most.
LIMIT, MOST_HEADS = 1_024, 1 << 20
#: Turns of a conversation that one row of a join is repeated for; ids in one folded string.
CHUNK, FOLD = 4_096, 1_024
SHARED, FAMILY = 6, 100
NOTHING = hashlib.sha256(b"").digest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, pos from 0, tid, chars), landed: in order of turn, null first, then of the id of (role, text).

    Null roles and texts are empty. Rows without a conversation are none. A conversation of any length is numbered over many tasks.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    tid = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("stated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        tid.alias("tid"), F.char_length(text).cast("long").alias("chars"),
    )
    placed = positions(rows, ["conv_id"], ["stated", "turn", "tid"])
    return land(placed.select("conv_id", "pos", "tid", "chars"), "turns")


def rebuilt(own: DataFrame, shared: int = SHARED, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Every conversation c anew: the first h turns of conversation c - c % family, then c's own after its first h; h = crc32(c) % shared.

    Gives (conv_id, length), turnless ones too, and the turns (conv_id, depth from 1, tid, chars), both landed.
    """
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < shared - 1, F.struct("pos", "tid", "chars"))))
    each = own.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("head"))
    base = each.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared))
    k = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = (
        each.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left").withColumn("k", k)
        .select("conv_id", "n", "h", "k", F.slice("base_head", F.lit(1), F.col("k").cast("int")).alias("head"),
                (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    )
    convs = land(convs, "rebuilt")
    heads = convs.select("conv_id", F.inline("head")).select("conv_id", (F.col("pos") + 1).alias("depth"), "tid", "chars")
    # The shift of a conversation reaches its rows by chunks of positions, so a long one is not one key.
    chunks = convs.where("n > h").select("conv_id", "h", "k", F.explode(F.sequence(F.expr(f"h div {CHUNK}L"), F.expr(f"(n - 1) div {CHUNK}L"))).alias("chunk"))
    tails = own.withColumn("chunk", F.expr(f"pos div {CHUNK}L")).join(chunks, ["conv_id", "chunk"]).where("pos >= h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "tid", "chars")
    return convs.select("conv_id", "length"), land(heads.unionByName(tails), "strings")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one string to rows of up to FOLD ids: (a, b, length, first, n, ids)."""
    held, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*held, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "length", "first", "n", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "length", "conv_id")), strict=True):
            if key != held or len(ids) == FOLD:
                close()
                held = key
            ids.append(conv)
        yield emit()
    close()
    yield emit()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded rows in order to one row for each string: its least conversation, their number, and the digest of their ids, read in a stream."""
    held, rep, n, digest, length, out = None, 0, 0, None, 0, []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["rep", "length", "copies", "ends"])
        out.clear()
        return batch

    for batch in batches:
        for a, b, size, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "length", "first", "n", "ids")), strict=True):
            if (a, b, size) != held:
                if held is not None:
                    out.append((rep, length, n, digest.digest()))
                held, rep, n, digest, length = (a, b, size), first, 0, hashlib.sha256(), size
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        yield emit()
    if held is not None:
        out.append((rep, length, n, digest.digest()))
    yield emit()


def distinct_strings(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Equal conversations folded: (rep: the least of them, length, copies, ends: SHA-256 of their ids, ascending, comma-joined; key: of the
    root), landed.

    Strings are told apart by 128 bits over their (depth, id) pairs, which add up in any order. Members of a string are ranged over all tasks
    and folded to lists of FOLD ids before one task reads them, in a stream, into the string's digest.
    """
    marks = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "tid")).alias("a"), F.bit_xor(F.xxhash64("tid", F.lit("second"), "depth")).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    members = convs.join(marks, "conv_id", "left").select(zero("a"), zero("b"), "length", "conv_id")
    sort = ["a", "b", "length", "conv_id"]
    folded = members.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_fold, "a long, b long, length long, first long, n long, ids string")
    each = folded.repartition("a", "b", "length").sortWithinPartitions("a", "b", "length", "first")
    strings = each.mapInArrow(_digest, "rep long, length long, copies long, ends binary")
    return land(strings.withColumn("key", F.lit(b"")), "distinct")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, each with its strings in order, to nodes. Only the path of the last string is a stack; one container's nodes are held."""
    fields = ("key", "depth", "parent_conv", "chars", "rep", "copies", "length", "ends", "tids", "lasts")
    names = [*(x.strip().split()[0] for x in NODES.split(",")), "top"]
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
    held, out = None, []
    nodes: list[list] = []  # [conv, depth, parent's place, n_convs, n_children, n_leaves, saved, ends, chars]

    def close(parent_conv: int | None) -> None:
        # Children stand after their parents.
        for node in reversed(nodes):
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if node[2] is not None:
                up = nodes[node[2]]
                up[0], up[3], up[4], up[5], up[6] = min(up[0], node[0]), up[3] + node[3], up[4] + 1, up[5] + node[5], up[6] + node[6]
        for node in nodes:
            conv = parent_conv if node[2] is None else nodes[node[2]][0]
            out.append((node[0], node[1], conv, *node[3:8], node[2] is None))
        nodes.clear()

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        out.clear()
        return batch

    path: list[int] = []
    before: list[bytes] = []
    above = None
    for batch in batches:
        for key, depth, parent_conv, chars, rep, copies, length, ends, tids, lasts in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
            if key != held:
                close(above)
                if len(out) >= 20_000:
                    yield emit()
                held, above, before = key, parent_conv, []
                nodes.append([rep, depth, None, 0, 0, 0, 0, NOTHING, chars])
                path = [0]
            same = 0
            for mine, last in zip(tids, before):
                if mine != last:
                    break
                same += 1
            del path[same + 1 :]
            for i in range(same, len(tids)):
                nodes.append([rep, depth + i + 1, path[-1], 0, 0, 0, 0, NOTHING, lasts[i]])
                path.append(len(nodes) - 1)
            end = nodes[path[-1]]
            end[0], end[3], end[7] = min(end[0], rep), copies, ends
            before = tids
        yield emit()
    close(above)
    yield emit()


def prefix_nodes(convs: DataFrame, turns: DataFrame, limit: int | None = None) -> DataFrame:
    """All nodes of the trie of strings: ``convs`` (conv_id, length) and ``turns`` (conv_id, depth from 1 without gaps, tid, chars).

    A node is named by its depth and its least member. The result has the columns NODES; ``ends`` is a digest of the members that end there.
    An empty table has no nodes, not even a root.
    """
    strings = distinct_strings(convs, turns)
    total = strings.agg(F.sum("length").alias("n")).first()["n"] or 0
    limit = max(limit or LIMIT, total // MOST_HEADS)
    nothing = F.lit(None).cast("long").alias("parent_conv")
    state = strings.select("key", nothing, F.lit(0).cast("long").alias("chars"), "rep", "copies", "length", "ends")
    heads, small, depth = [], [], 0
    while True:
        ended = F.col("length") == depth
        sized = state.groupBy("key").agg(
            F.min("rep").alias("conv"), F.first("parent_conv").alias("parent_conv"), F.first("chars").alias("chars"), F.sum("copies").alias("n_convs"),
            F.max(F.when(ended, F.col("ends"))).alias("ends"), F.count("*").alias("strings"), F.sum(F.col("length") - depth).alias("left"),
        )
        large = land(sized.where((F.col("strings") > 1) & (F.col("left") > limit)), "heads")
        if large.isEmpty():
            small.append(state.withColumn("depth", F.lit(depth).cast("long")))
            break
        # At most MOST_HEADS rows: each has more than ``limit`` turns to itself.
        named = F.broadcast(large.select("key", F.col("conv").alias("head_conv")))
        small.append(state.join(F.broadcast(large.select("key")), "key", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        heads.append(large)
        going = state.where(~ended).join(named, "key").select("key", F.col("head_conv").alias("parent_conv"), "rep", "copies", "length", "ends")
        following = turns.where(F.col("depth") == depth + 1).select(F.col("conv_id").alias("rep"), "tid", "chars")
        burst = F.unhex(F.md5(F.concat("key", "tid")))
        depth += 1
        state = land(going.join(following, "rep").select(burst.alias("key"), "parent_conv", "chars", "rep", "copies", "length", "ends"), "burst")
    settled = small[0]
    for more in small[1:]:
        settled = settled.unionByName(more)
    # A container that did not burst has at most ``limit`` + 1 strings, so it may be a window.
    settled = land(settled.withColumn("strings", F.count("*").over(Window.partitionBy("key"))), "containers")
    rows = _rows_of(settled, turns)
    nodes = land(_paths(settled, rows).unionByName(_swept(settled, rows)), "nodes")
    return nodes.drop("top").unionByName(_head_nodes(heads, nodes.where("top").drop("top"))) if heads else nodes.drop("top")


def _rows_of(settled: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of the settled strings below the heads of their containers, joined by chunks so that a long string is not one key."""
    chunk = F.explode(F.sequence(F.expr(f"(depth + 1) div {CHUNK}L"), F.expr(f"length div {CHUNK}L"))).alias("chunk")
    asked = settled.where("length > depth").select("key", "rep", "copies", "length", "ends", "strings", F.col("depth").alias("top_depth"), chunk)
    given = turns.select(F.col("conv_id").alias("rep"), "depth", "tid", F.col("chars").alias("last"), F.expr(f"depth div {CHUNK}L").alias("chunk"))
    return asked.join(given, ["rep", "chunk"]).where("depth > top_depth")


def _paths(settled: DataFrame, rows: DataFrame) -> DataFrame:
    """Containers of one string: a node for the top and one for each turn below it."""
    below = rows.where("strings = 1")
    again = running_totals(below.where("copies > 1").withColumn("back", F.col("length") - F.col("depth")), ["rep"], "back", {"under": F.col("last")})
    single = below.where("copies = 1").withColumn("under", F.lit(0).cast("long"))
    named = ["rep", "depth", "copies", "length", "ends", "under"]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    under = F.col("under") * (F.col("copies") - 1)

    def shaped(df: DataFrame, parent, saved, top: bool) -> DataFrame:
        last = F.col("length") == F.col("depth")
        return df.select(
            F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends"), F.lit(top).alias("top"),
        )

    turns = shaped(single.select(*named).unionByName(again.select(*named)), F.col("rep"), under, False)
    sums = below.where("copies > 1").groupBy("rep").agg(F.sum("last").alias("under"))
    tops = settled.where("strings = 1").join(sums, "rep", "left").withColumn("under", F.coalesce("under", zero) + F.col("chars"))
    return turns.unionByName(shaped(tops, F.col("parent_conv"), under, True))


def _swept(settled: DataFrame, rows: DataFrame) -> DataFrame:
    """Containers of several strings: strings as arrays of ids, sorted by Spark within their containers, then swept."""
    listed = F.sort_array(F.collect_list(F.struct("depth", "tid", "last")))
    arrays = rows.where("strings > 1").groupBy("rep").agg(listed.alias("turns"))
    many = settled.where("strings > 1").join(arrays, "rep", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<depth:bigint,tid:binary,last:bigint>>")))
    strings = many.select("key", "depth", "parent_conv", "chars", "rep", "copies", "length", "ends", F.col("turns.tid").alias("tids"), F.col("turns.last").alias("lasts"))
    shards = strings.repartition("key").sortWithinPartitions("key", "tids")
    return shards.mapInArrow(_sweep, NODES + ", top boolean")


def _head_nodes(heads: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the heads, from the deepest level up: sums over the containers' tops and over the heads right below."""
    sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    below = land(tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv")).agg(*sums), "tops")
    out, lower = None, None
    for depth in range(len(heads) - 1, -1, -1):
        parts = below.where(F.col("depth") == depth).drop("depth")
        if lower is not None:
            parts = parts.unionByName(lower.groupBy(F.col("parent_conv_id").alias("conv")).agg(*sums))
        parts = parts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        lower = heads[depth].join(parts, "conv").select(
            F.col("conv").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"),
        )
        lower = land(lower, "head-nodes")
        out = lower if out is None else out.unionByName(lower)
    return out


def report(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """Every node of the trie of rebuilt conversations, once. Repeated rows are turns of their own, other columns are not read."""
    convs, turns = rebuilt(turn_rows(conversations))
    return prefix_nodes(convs, turns, limit).select(*[c.strip().split()[0] for c in NODES.split(",")[:-1]], F.lower(F.hex("ends")).alias("ends_sha256"))
