"""Document fingerprints: bottom-k sketches of word shingles, by DataFrame functions alone.

A text is the set of its runs of five words (words are runs without spaces; a text of fewer words, but not none, is one run). Its
sketch is the ``k`` least 64-bit hashes of that set, so sketches of parts merge into the sketch of the whole (:func:`merged`), two
sketches estimate how alike the sets are (:func:`resemblance`), how much of one is in the other (:func:`containment`), and one
estimates how many different runs there are (:func:`distinct_shingles`). Sets of fewer than ``k`` runs are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import width

WORDS, K = 5, 128
_DIGITS = 16


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in names]


def sketched(docs: DataFrame, text: str = "text", out: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    """All rows and columns of ``docs`` and ``out``: the ascending ``k`` least hashes (16 hex digits) of the runs of ``words`` words of ``text``.

    A null or wordless text has the empty sketch. Repeated runs count once, repeated rows stay, a column of the name ``out`` is replaced.
    A text is held as the array of its words while its row is worked on.
    """
    w, s = _fresh(docs, "__words", "__runs")
    # Columns of their own, each used more than once: Spark then does not put one inside the other's lambda.
    spaced = docs.withColumn(w, F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
    run = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ").cast("binary")), 1, _DIGITS))
    none = F.array().cast("array<string>")
    runs = spaced.withColumn(s, F.when(F.size(w) > 0, run).otherwise(none)).drop(w)
    return runs.withColumn(out, F.slice(F.sort_array(F.array_distinct(s)), 1, k)).drop(s)


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of sketches: the sketch of the union of their sets.

    Hashes of a group fold to distinct ones in each task, and each task passes on its ``k`` least alone, so a group that holds a third
    of all rows is no burden. Groups of empty sketches have the empty sketch; a null key is a key.
    """
    h, = _fresh(sketches, "__hash")
    hashes = sketches.select(*by, F.explode_outer(sketch).alias(h)).distinct()
    least = hashes.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(h).asc_nulls_last()))).where(F.col("__rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list(h)).alias(sketch))


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both have, 0 to 1: an unbiased estimate of the sets' Jaccard similarity. Two empty sets are alike."""
    union = _union(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different runs: exact below ``k``, else from how small the ``k``-th hash is."""
    kth = F.conv(F.substring(F.element_at(a, -1), 1, 12), 16, 10).cast("double") + 1.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(16**12) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s runs that ``b`` has too, 0 to 1. The empty set is contained in any."""
    shared = resemblance(a, b, k) * distinct_shingles(_union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(sketch: Column) -> Column:
    """The sketch as one string, hash by hash."""
    return F.array_join(sketch, "")


class Blocks:
    """Descending ``key`` cut into blocks of about equal row counts. The bounds, each the largest key of its block, are one number for
    each of Spark's range partitions, over the keys alone; only they reach the driver."""

    def __init__(self, docs: DataFrame, key: str):
        keys = docs.select(F.col(key).alias("k")).where("k is not null")
        parts = keys.repartitionByRange(4 * width(docs.sparkSession), F.col("k").desc())
        largest = parts.groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect()
        self.bounds = sorted({r["k"] for r in largest}, reverse=True)
        self.count = max(1, len(self.bounds))

    def of(self, key: Column) -> Column:
        """Number of the block of a key; null keys come last."""
        if not self.bounds:
            return F.lit(0)
        step = max(1, round(self.count**0.5))
        listed = lambda keys: F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>")
        passed = lambda keys: F.size(F.filter(keys, lambda b: b >= key))
        coarse = (passed(listed(self.bounds[::step])) - 1) * step
        fine = coarse + passed(F.slice(listed(self.bounds), coarse + 1, step)) - 1
        return F.when(key.isNull(), F.lit(self.count - 1)).otherwise(fine)

    def first(self, block: Column) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, self.bounds))), ",").cast("array<bigint>"), block) if self.bounds else F.lit(None).cast("bigint")


def with_next(docs: DataFrame, text: str = "text", out: str = "next", key: str = "doc_id", k: int = K, words: int = WORDS) -> DataFrame:
    """Each document with its ``sketch`` and the struct ``out`` of the next document by descending ``key``: its ``text`` and ``sketch``.

    After the last comes the first, so a single document follows itself. Null keys come last; documents with the same key are in order
    of their texts, null first. One shuffle of the texts: a document goes to the block of its key, and the first one of each block also
    to the block before, where it ends the line.
    """
    blocks = Blocks(docs, key)
    home, guest = _fresh(docs, "__home", "__guest")
    block = docs.withColumn(home, blocks.of(F.col(key)))
    before = F.when(F.col(home) == 0, F.lit(blocks.count - 1)).otherwise(F.col(home) - 1)
    place = lambda b, away: F.struct(b.cast("int").alias("b"), F.lit(away).alias("g"))
    places = F.when(F.col(key).eqNullSafe(blocks.first(F.col(home))), F.array(place(F.col(home), False), place(before, True)))
    dealt = block.withColumn(home, F.explode(places.otherwise(F.array(place(F.col(home), False)))))
    dealt = dealt.withColumn(guest, F.col(f"{home}.g")).withColumn(home, F.col(f"{home}.b")).repartition(home)
    line = Window.partitionBy(home).orderBy(guest, F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())
    both = sketched(dealt, text, "sketch", k, words).withColumn(out, F.lead(F.struct(text, "sketch")).over(line))
    return both.where(~F.col(guest)).drop(home, guest)


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: sizes, the digest of its edited text, and fingerprints with their likeness.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones, or all, of the next document by
    descending ``doc_id``. Null texts are empty, repeated rows and ids are documents of their own, other columns are not read.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lined = with_next(chosen, k=k).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept, added = F.left("text", F.col("n_chars").cast("int") - half), F.left(F.col("next.text"), half)
    edited = sketched(lined.withColumn("edited", F.concat(kept, added)), "edited", "edited_sketch", k)
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next.sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
    )
