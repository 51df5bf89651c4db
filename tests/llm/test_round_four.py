"""Sizes of what operators exchange, and calls of the libraries they use."""

import numpy as np
import pyarrow as pa

from tapeloom.llm import katz, packing
from tapeloom.llm.queries import tokenizer


def exchanged(chunks: list[pa.Table], buckets: int = 16) -> tuple[int, int]:
    """Distinct pairs of all chunks and the compressed bytes in which they ask for their counts."""
    made = [katz.Chunk(t) for t in chunks]

    def dealt(sent):
        got = {}
        for k, rows in enumerate(sent):
            for bucket, kind, payload in rows:
                got.setdefault(bucket, {}).setdefault(kind, []).append((k, payload))
        return got

    found, stats = [{} for _ in made], np.zeros(3 + katz.HIGHEST, np.int64)
    for bucket, got in dealt([c.ask(buckets, 1) for c in made]).items():
        for k, kind, payload in katz._reply_first(1)(bucket, got):
            if k < 0:
                stats = stats + np.frombuffer(payload, "<i8")
            else:
                found[k][kind, bucket] = payload
    for c, f in zip(made, found, strict=True):
        c.learn(f, buckets, 10, 1)
    sent = [c.ask_counts(buckets, int(stats[0])) for c in made]
    blobs = b"".join(payload for rows in sent for *_, payload in rows)
    return sum(len(c.pairs) for c in made), len(pa.Codec("lz4").compress(blobs))


def test_pairs_of_lm_scoring_travel_by_numbers_of_their_words():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(20_000)])
    chunks = []
    for k in range(3):
        texts = [" ".join(words[(20_000 * rng.random(500) ** 3).astype(int)]) for _ in range(60)]
        chunks.append(pa.table({"doc_id": pa.array(range(60 * k, 60 * k + 60), pa.int64()), "text": texts, "held_out": [False] * 60}))
    pairs, size = exchanged(chunks)
    assert size < 8 * pairs


def test_new_words_of_packing_are_encoded_together():
    """Few texts reach the library, and ids are those of whole texts, odd blanks and special strings among them."""
    encoder = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    words = [f"Wort{i}" for i in range(3_000)] + ["naïve", "x\ny\n\n", "<|endoftext|>", "a<|endoftext|>b", "😀", "don't", "é\u0301", "\x1c", "\u00a0z", "…"]
    texts = [" ".join(words[k::7]) for k in range(7)] + ["  two  blanks ", "", "\n lines \n\n  of \t text ", "tail  ", " ", "\x1c y", "<|endoftext|> <|endoftext|>"]
    library, calls = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, batch, **options):
            calls.append(len(batch))
            return library.encode_batch_fast(batch, **options)

    encoder.tokenizer = Counted()
    got = encoder.many(texts)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(calls) <= len(texts) + 10
