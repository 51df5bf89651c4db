"""The operators as queries over whole tables, with production settings, and their SQL twins where SQL can say it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, katz, minhash, packing, quality, sharding, substrings, suffixes, tokencounts, toxicity, trie, twins, whitening

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tapeloom-"), "tapeloom-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _query(work: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return work(lambda table: _read(spark, sf_dir, table))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _query(lambda t: decontaminate.report(t("documents"), t("benchmark"))),
    "op2_substring_dedup": _query(lambda t: substrings.report(t("documents"))),
    "op3_best_fit_packing": _query(lambda t: packing.pack(t("documents"), tokenizer("byte_bpe_50k.json"))),
    "op4_minhash_near_dedup": _query(lambda t: minhash.report(t("documents"))),
    "op5_toxicity": _query(lambda t: toxicity.report(t("documents"), t("labels"))),
    "op6_suffix_dedup": _query(lambda t: suffixes.report(t("documents"))),
    "op7_sharding": _query(lambda t: sharding.report(t("documents"))),
    "op8_quality_rules": _query(lambda t: quality.report(t("documents"), t("labels"))),
    "op9_lm_scoring": _query(lambda t: katz.report(t("documents"), least=1)),
    "op10_token_counts": _query(lambda t: tokencounts.report(t("documents"), tokenizer("piece_bpe_32k.model"))),
    "op11_conversation_trie": _query(lambda t: trie.report(t("conversations"))),
    "op12_document_fingerprints": _query(lambda t: fingerprints.report(t("documents"))),
    "op13_embedding_whitening": _query(lambda t: whitening.report(t("embeddings"))),
}

#: Results that SQL can say exactly. The method's own choices (darts, draws, weights, packing order, tokenizers) have no SQL;
#: the twin tried for op6 did not end in a minute at sf0.01, for a cause not found. See the tests for these.
ORACLES: dict[str, str] = {
    "op1_decontamination": twins.DECONTAMINATION,
    "op2_substring_dedup": twins.SUBSTRINGS,
    "op11_conversation_trie": twins.TRIE,
    "op12_document_fingerprints": twins.FINGERPRINTS,
}
