"""A small corpus with every odd case: nulls, empties, ties, copies, near copies, long texts and clashing columns."""

import random

import pytest

from tapeloom.llm.queries import ship

WORDS = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "über", "a", "of", "the"]


@pytest.fixture(scope="session")
def corpus():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
    passage, base, item = prose(70), prose(120), prose(30)
    texts = [None, "", "  \n ", "one", prose(3), base, base, base.replace("alpha", "omega", 1), passage, f"{prose(40)} {passage} {prose(5)}",
             f"{passage}\n{prose(60)} {passage}", "é" * 300, "é" * 301 + "x", prose(6000), f"{prose(9)} {item} {prose(20)}", item.upper(),
             " ".join(["same line of words here again and"] * 40), "\n".join([prose(4)] * 3 + ["", "x y"]), "a  b \t c\x00d <|endoftext|> "]
    return [(i, t) for i, t in enumerate(texts + [prose(rng.randrange(5, 90)) for _ in range(40)])], [(7, item), (8, prose(5)), (9, None), (10, "")]


@pytest.fixture(scope="session")
def tables(spark, corpus):
    ship(spark)
    rows, items = corpus
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int")
    return docs.repartition(3), spark.createDataFrame(items, "item_id long, text string")
