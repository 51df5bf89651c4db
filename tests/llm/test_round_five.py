"""Bytes that an operator's own shuffles move, where no table is small enough to be broadcast."""

import numpy as np

from tapeloom.llm import chunks, minhash


def shuffled(spark, work) -> tuple[list, int]:
    """Rows of ``work()`` and the bytes that its stages wrote to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, *none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return work().collect(), written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_without_near_copies_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in rng.integers(1 << 40, 1 << 44, 1_000).tolist()) for _ in range(400)]
    texts[7] = texts[300].replace(" ", "\n", 1) + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    left, moved = shuffled(spark, lambda: minhash.clean_rows(docs))
    assert {tuple(r) for r in left} == {(i, t) for i, t in enumerate(texts) if i != 300}
    assert moved < sum(map(len, texts)) / 2


def test_picked_rows_of_chunks_with_many_rows(spark):
    """Row numbers tell chunk and place, in the order of reading; odd column names and absent numbers do no harm."""
    docs = spark.range(1_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, repeat('x', int(id % 5))) AS text", "named_struct('a b', id) AS `c,d`").coalesce(1)
    landed = chunks.chunked(docs, 64, 10, doc_id=docs["doc_id"], text=docs["text"], c0=docs["`c,d`"])
    rows = sorted(landed.collect(), key=lambda r: r.rid)
    assert [r.doc_id for r in rows] == list(range(1_000)) and all(r.rid >> chunks.PLACE_BITS == r.chunk for r in rows)
    sizes = np.bincount([r.chunk for r in rows])
    assert sizes.max() == 10 and len(sizes) > 90
    wanted = [r.rid for r in rows[::7]]
    got = chunks.picked(landed, spark.createDataFrame([(r,) for r in [*wanted, wanted[0], 1 << 50]], "rid long"))
    assert got.columns == landed.columns and sorted(r.rid for r in got.collect()) == wanted
    assert all(r.c0["a b"] == r.doc_id for r in got.collect())
