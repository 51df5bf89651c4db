"""Katz backoff scoring of whole texts with bigrams over unigrams, Good-Turing discounts and exact normalisation.

    p(w)     = d1[c(w)] c(w) / N                     for a word seen in training; what is left over is the unseen word's
    p(w | u) = s(u) d2[c(u w)] c(u w) / c(u)         if the pair was seen at least ``least`` times
             = a(u) p(w)                             otherwise

``a(u)`` makes the probabilities after ``u`` add up to one over all words and the unseen one; ``s(u)`` is 1 unless that would
leave less than one count in ``c(u) + 1``. With a ``least`` of 1 every pair counts and all travel whole. With a larger one 32-bit keys of
all pairs are exchanged first, and only pairs that may be frequent enough travel whole. Counts lie in tables partitioned by key. A chunk
asks for each distinct word, pair and context once, in the second exchange by the numbers that the first one gave the words; a context as frequent as to fill a bucket is cut by the word that follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answer, buckets_of, chunked, pack, parts_of, send, send_again, short, steps, together, unpack, whole
from .scan import LOWER, SPACED, mix, scan, text_bytes

#: Counts up to this one are discounted.
HIGHEST = 5
#: Pairs seen less often are left to the backoff if nothing else is asked for.
LEAST = 1

_WORDS, _PAIRS, _COUNTS, _STATS = 0, 1, 2, 9
_END, _BEGIN = np.uint64(0xE4D0F7E275E9D1A7), np.uint64(0xB361A0D05747C69B)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: What a chunk learns of a context: pairs seen 1 to 5 times, sum of the larger counts, share of ``p`` that its pairs have.
_CONTEXT = np.dtype([("few", "<u4", (HIGHEST,)), ("more", "<u8"), ("share", "<f8")])


def discounts(seen: dict[int, int], highest: int = HIGHEST) -> np.ndarray:
    """Good-Turing factors of the counts 0 to ``highest`` (1 where the counts of counts allow none), by Katz's formula."""
    out = np.ones(highest + 2)
    n1 = seen.get(1, 0)
    edge = (highest + 1) * seen.get(highest + 1, 0) / n1 if n1 else 1.0
    for r in range(1, highest + 1):
        if n1 and edge < 1 and seen.get(r, 0) and seen.get(r + 1, 0):
            factor = ((r + 1) * seen[r + 1] / (r * seen[r]) - edge) / (1 - edge)
            if 0 < factor < 1:
                out[r] = factor
    return out


class Unigrams:
    """Probabilities of words from their counts."""

    def __init__(self, stats: np.ndarray):
        self.total, self.distinct = int(stats[0]), int(stats[1])
        self.factors = discounts({r: int(stats[1 + r]) for r in range(1, HIGHEST + 2)})
        kept = self.total - sum((1 - self.factors[r]) * r * int(stats[1 + r]) for r in range(1, HIGHEST + 1))
        # Without any discount one count is set aside for the unseen word.
        self.scale = 1 / max(self.total, 1) if kept < self.total - 0.5 else 1 / (self.total + 1)
        self.unseen = 1 - kept * self.scale

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        return np.where(counts > 0, self.factors[np.minimum(counts, HIGHEST + 1).astype(np.int64)] * c * self.scale, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(np.float64) + 1) / (self.total + self.distinct + 1))


class Chunk:
    """Tokens of a chunk with their contexts, folded to distinct words and pairs in order of their hashes."""

    def __init__(self, table: pa.Table):
        data, offsets = text_bytes(table.column("text"))
        words = scan(data, offsets, SPACED, LOWER)
        rows = table.num_rows
        self.first = words.first + np.arange(rows + 1)
        token = np.empty(len(words) + rows, np.uint64)
        token[np.arange(len(words)) + words.row] = words.hash
        token[self.first[1:] - 1] = _END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.first[:-1]] = _BEGIN
        held = table.column("held_out").to_numpy().astype(bool) if rows else np.zeros(0, bool)
        train = np.repeat(~held, np.diff(self.first))
        self.words, self.word = np.unique(token, return_inverse=True)
        self.word_counts = np.bincount(self.word[train], minlength=len(self.words))
        self.pairs, at, self.pair = np.unique(mix(context * _PAIR + token), return_index=True, return_inverse=True)
        self.pair_counts = np.bincount(self.pair[train], minlength=len(self.pairs))
        self.pair_context, self.pair_word = context[at], self.word[at]
        self.word = self.word.astype(np.int32)
        self.pair = self.pair.astype(np.int32)

    def ask(self, buckets: int, least: int) -> list[tuple[int, int, bytes]]:
        out = [(b, _WORDS, pack(steps(self.words[p]), self.word_counts[p].astype("<u4"))) for b, p in parts_of(self.words, buckets)]
        for b, p in parts_of(self.pairs, buckets) if least > 1 else ():
            n = self.pair_counts[p]
            out.append((b, _PAIRS, pack(steps(short(self.pairs[p], b, buckets)), np.packbits(n > 0), np.packbits(n > 1))))
        return out

    def learn(self, found: dict, buckets: int, documents: int, least: int) -> None:
        """Corpus counts of the words, which pairs may be frequent enough, and the distinct contexts worth asking for."""
        self.count = np.zeros(len(self.words), np.int64)
        self.number = np.zeros(len(self.words), np.uint64)
        for b, p in parts_of(self.words, buckets):
            self.count[p], rank = unpack(found[_WORDS, b], "<u8", "<u4")
            self.number[p] = rank.astype(np.uint64) * np.uint64(buckets) + np.uint64(b + 1)
        again = np.full(len(self.pairs), least <= 1)
        for b, p in parts_of(self.pairs, buckets) if least > 1 else ():
            again[p] = np.unpackbits(np.frombuffer(found[_PAIRS, b], np.uint8), count=p.stop - p.start)
        self.contexts, self.pair_nth = np.unique(self.pair_context, return_inverse=True)
        place = np.minimum(np.searchsorted(self.words, self.contexts), max(0, len(self.words) - 1))
        self.context_count = np.where(self.contexts == _BEGIN, documents, self.count[place] if len(self.words) else 0)
        self.context_number = np.where(self.contexts == _BEGIN, np.uint64(0), self.number[place] if len(self.words) else np.uint64(0))
        self.least = least
        self.chosen = np.flatnonzero(again & (self.context_count[self.pair_nth] >= least))

    def requests(self, buckets: int, total: int):
        """Per bucket: its contexts and its chosen pairs, in order of the numbers of the contexts and of the pairs' words."""
        asked = np.flatnonzero(self.context_count >= self.least)
        cuts = _cuts(self.context_count[asked], buckets, total)
        context = np.repeat(asked, cuts)
        turn = np.arange(len(context)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        context_bucket = _bucket(self.contexts[context], turn, buckets)
        own = _cuts(self.context_count[self.pair_nth[self.chosen]], buckets, total)
        turn = (mix(self.words[self.pair_word[self.chosen]] ^ np.uint64(3)) % own.astype(np.uint64)).astype(np.int64)
        pair_bucket = _bucket(self.pair_context[self.chosen], turn, buckets)
        pair_order = np.lexsort((self.context_number[self.pair_nth[self.chosen]], self.number[self.pair_word[self.chosen]], pair_bucket))
        context_order = np.lexsort((self.context_number[context], context_bucket))
        context, context_bucket = context[context_order], context_bucket[context_order]
        again = np.zeros(len(context), bool)  # two cuts of a context may fall into one bucket
        again[1:] = (context[1:] == context[:-1]) & (context_bucket[1:] == context_bucket[:-1])
        context, context_bucket = context[~again], context_bucket[~again]
        pairs, pair_bucket = self.chosen[pair_order], pair_bucket[pair_order]
        context_ends = np.searchsorted(context_bucket, np.arange(buckets + 1))
        pair_ends = np.searchsorted(pair_bucket, np.arange(buckets + 1))
        for b in np.unique(context_bucket).tolist():
            yield b, context[context_ends[b] : context_ends[b + 1]], pairs[pair_ends[b] : pair_ends[b + 1]]

    def ask_counts(self, buckets: int, total: int) -> list[tuple[int, int, bytes]]:
        out = []
        for b, contexts, pairs in self.requests(buckets, total):
            known = self.context_number[contexts]
            at = np.searchsorted(known, self.context_number[self.pair_nth[pairs]])
            word = self.pair_word[pairs]
            out.append((b, _COUNTS, pack(steps(known), at.astype("<u4"), steps(self.number[word]), self.pair_counts[pairs].astype("<u4"), _turned(self.count[word]))))
        return out


def _turned(counts: np.ndarray) -> np.ndarray:
    """Differences of counts with the sign as their last bit: words come by rank, so most are small."""
    d = np.diff(counts, prepend=np.int64(0))
    return ((d << 1) ^ (d >> 63)).astype("<u8")


def _turned_back(differences: np.ndarray) -> np.ndarray:
    z = differences.astype(np.int64)
    return np.cumsum((z >> 1) ^ -(z & 1))


def _cuts(counts: np.ndarray, buckets: int, total: int) -> np.ndarray:
    """Into how many parts a context is cut: as many as it would fill quarters of a bucket."""
    return np.minimum(1 + (4.0 * buckets * counts / max(total, 1)).astype(np.int64), buckets)


def _bucket(context: np.ndarray, turn: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(context + turn.astype(np.uint64) * _PAIR) % np.uint64(buckets)).astype(np.int64)


def _reply_first(least: int):
    def reply(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
        out, stats = [], np.zeros(3 + HIGHEST, np.int64)
        if sent := [(chunk, *unpack(payload, "<u8", "<u4")) for chunk, payload in got.get(_WORDS, [])]:
            sent = [(chunk, whole(k), n) for chunk, k, n in sent]
            keys, where = np.unique(np.concatenate([k for _, k, _ in sent]), return_inverse=True)
            totals = np.zeros(len(keys), np.int64)
            np.add.at(totals, where, np.concatenate([n for *_, n in sent]).astype(np.int64))
            ends = np.cumsum([len(k) for _, k, _ in sent])
            # From here on a word is its rank by count in this bucket: ranks are short, and sorted ones have close counts.
            rank = np.empty(len(keys), np.int64)
            rank[np.argsort(-totals, kind="stable")] = np.arange(len(keys))
            out += [(chunk, _WORDS, pack(totals[w].astype("<u8"), rank[w].astype("<u4"))) for (chunk, *_), w in zip(sent, np.split(where, ends[:-1]), strict=True)]
            stats[0], stats[1] = totals.sum(), (totals > 0).sum()
            stats[2:] = [(totals == r).sum() for r in range(1, HIGHEST + 2)]
        if sent := [(chunk, *unpack(payload, "<u4", "u1", "u1")) for chunk, payload in got.get(_PAIRS, [])]:
            sent = [(chunk, whole(k), x, y) for chunk, k, x, y in sent]
            size = [len(k) for _, k, *_ in sent]
            key = np.concatenate([k for _, k, *_ in sent])
            seen = np.concatenate([np.unpackbits(x, count=len(k)) + np.unpackbits(y, count=len(k)) for _, k, x, y in sent])
            order = np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            often = np.add.reduceat(seen[order].astype(np.int64), np.flatnonzero(new)) >= least if len(key) else new
            marks = np.empty(len(key), bool)
            marks[order] = often[np.cumsum(new) - 1]
            out += [(chunk, _PAIRS, np.packbits(x).tobytes()) for (chunk, *_), x in zip(sent, np.split(marks, np.cumsum(size)[:-1]), strict=True)]
        return [*out, (-1, _STATS, stats.tobytes())]

    return reply


def _reply_counts(unigrams: Unigrams, least: int):
    def reply(bucket: int, got: dict) -> list[tuple[int, int, bytes]]:
        sent = [(chunk, *unpack(payload, "<u8", "<u4", "<u8", "<u4", "<u8")) for chunk, payload in got.get(_COUNTS, [])]
        sent = [(chunk, whole(contexts), at, whole(words), n, _turned_back(alone)) for chunk, contexts, at, words, n, alone in sent]
        context = np.concatenate([c[at] for _, c, at, *_ in sent])
        word, count, alone = (np.concatenate([x[i] for x in sent]) for i in (3, 4, 5))
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        start = np.flatnonzero(new)
        total = np.add.reduceat(count[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        everywhere = np.empty(len(order), np.int64)
        everywhere[order] = total[np.cumsum(new) - 1]
        stats = np.array([total[total >= least].sum(), *[(total == r).sum() for r in range(least, HIGHEST + 2)]], np.int64)
        kept = total >= least
        u, c, p = context[order][start][kept], total[kept], unigrams.p(alone[order][start][kept].astype(np.int64))
        keys, nth = np.unique(u, return_inverse=True)
        known = np.zeros(len(keys), _CONTEXT)
        for r in range(least, HIGHEST + 1):
            known["few"][:, r - 1] = np.bincount(nth[c == r], minlength=len(keys))
        known["more"] = np.bincount(nth, weights=np.where(c > HIGHEST, c, 0), minlength=len(keys))
        known["share"] = np.bincount(nth, weights=p, minlength=len(keys))
        out, at = [(-1, _STATS, stats.tobytes())], 0
        for chunk, contexts, _, words, *_ in sent:
            place = np.minimum(np.searchsorted(keys, contexts), max(0, len(keys) - 1))
            has = keys[place] == contexts if len(keys) else np.zeros(len(contexts), bool)
            out.append((chunk, _COUNTS, pack(everywhere[at : at + len(words)].astype("<u8"), np.packbits(has), known[place[has]])))
            at += len(words)
        return out

    return reply


def _stats(answers: DataFrame, size: int) -> np.ndarray:
    """Sums of the buckets' own figures: one short row each."""
    rows = answers.where("chunk < 0").select("payload").toLocalIterator()
    return sum((np.frombuffer(r["payload"], "<i8") for r in rows), np.zeros(size, np.int64))


def scored(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document, learned where ``held_out`` is false.

    A null text is empty: one end token. A null ``held_out`` counts as true. Without training rows every token is the unseen
    one with probability 1. Pairs seen less than ``least`` times, which is 1 or 2, are left to the backoff. Repeated rows are counted and scored each by itself. Scores are log10 probabilities.
    """
    if least not in (1, 2):
        raise ValueError(f"least is {least}: pairs are left out below one or two times only")
    buckets = buckets_of(docs.sparkSession)
    landed = chunked(docs, doc_id=F.col(id).cast("long"), text=F.col(text), held_out=F.coalesce(held_out, F.lit(True)))
    keep = ("text", "held_out")
    first = answer(send(landed, lambda _, t: Chunk(t).ask(buckets, least), keep), _reply_first(least))
    unigrams = Unigrams(_stats(first, 3 + HIGHEST))
    documents = landed.where("not held_out").count()
    first = first.where("chunk >= 0")

    def ask(_, table: pa.Table, found: dict) -> list[tuple]:
        chunk = Chunk(table)
        chunk.learn(found, buckets, documents, least)
        return chunk.ask_counts(buckets, unigrams.total)

    second = answer(send_again(landed, first, ask, keep), _reply_counts(unigrams, least))
    stats = _stats(second, 2 + HIGHEST + 1 - least)
    frequent = {r: int(stats[1 + r - least]) for r in range(least, HIGHEST + 2)}
    factors = discounts({1: unigrams.total - int(stats[0]), **frequent})
    second = second.where("chunk >= 0")

    def score(_, table: pa.Table, found: dict) -> pa.Table:
        chunk = Chunk(table)
        chunk.learn(found, buckets, documents, least)
        pair = np.zeros(len(chunk.pairs), np.int64)
        taken, share = np.zeros(len(chunk.contexts)), np.zeros(len(chunk.contexts))
        for b, contexts, pairs in chunk.requests(buckets, unigrams.total):
            counts, bits, rows = unpack(found[_COUNTS, b], "<u8", "u1", _CONTEXT)
            pair[pairs] = counts
            has = contexts[np.unpackbits(bits, count=len(contexts)).astype(bool)]
            taken[has] += rows["few"] @ (factors[1 : HIGHEST + 1] * np.arange(1, HIGHEST + 1)) + rows["more"]
            share[has] += rows["share"]
        count = np.maximum(chunk.context_count, 1)
        taken = taken / count
        scale = np.where(1 - taken < 1 / (count + 1), count / (count + 1), 1.0)
        backoff = np.where(taken > 0, (1 - scale * taken) / (1 - share), 1.0)
        p1 = unigrams.p(chunk.count)
        nth, word = chunk.pair_nth, chunk.pair_word
        direct = scale[nth] * factors[np.minimum(pair, HIGHEST + 1)] * pair / count[nth]
        log = np.log10(np.where(pair >= least, direct, backoff[nth] * p1[word]))
        row = np.repeat(np.arange(table.num_rows), np.diff(chunk.first))
        total = lambda x: np.bincount(row, weights=x, minlength=table.num_rows)
        n = np.diff(chunk.first)
        columns = [table.column("doc_id"), table.column("held_out"), pa.array(n), pa.array(total(chunk.count[chunk.word] > 0).astype(np.int64)),
                   pa.array(np.full(len(n), unigrams.total)), pa.array(total(unigrams.base(chunk.count)[chunk.word])), pa.array(total(log[chunk.pair]))]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together(landed, first.unionByName(second), score, schema, keep)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Scores with the fixed split: rows whose crc32(doc_id as text) mod 7 is 2 are held out."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return scored(docs, key % 7 == 2, least=least)
