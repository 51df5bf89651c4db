"""Exact token counts at every prefix of a text, by dynamic programming over pieces that no token can span.

The sentencepiece model turns a space into the sign U+2581 and never joins a sign to a character before it: no entry
of its vocabulary has the sign behind another character, which is checked when the model is loaded. A text
therefore falls into pieces, each a run of spaces with the characters up to the next space, whose tokens do not depend on
their neighbours, and

    count(prefix) = count(prefix up to its last piece) + count(its part of that piece)

Inside a piece the last token of each prefix follows from those of shorter prefixes: it is the one vocabulary entry that ends the
prefix and stays apart from the last token of what is before it, and

    count(prefix) = count(prefix without its last token) + 1

so a prefix costs as many lookups as the longest entry has characters. That two tokens stay apart is worked out once for each two,
by merging their characters. The library counts each whole piece too: a piece it disagrees on is counted by the library, prefix by prefix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import slices

SIGN = "▁"
#: Pieces whose counts a task remembers; others are counted when met.
REMEMBERED = 300_000

_CUT = re.compile(r"(?<=[^ ]) (?= *[^ ])")
_UNEVEN = re.compile(r"  | \Z|\A ")


class Model:
    """A sentencepiece model with remembered counts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(SIGN in name.lstrip(SIGN) for name in names):
            raise ValueError(f"{path}: a token has a space behind another character, so texts cannot be cut at spaces")
        sizes = range(self.model.get_piece_size())
        plain = [i for i in sizes if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in plain}
        # Entries read from their ends: each character leads on, and "" marks that an entry is whole.
        self.back: dict = {}
        for name in self.score:
            node = self.back
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[""] = {}
        self.bytewise = any(map(self.model.is_byte, sizes))
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.steps: dict[str, np.ndarray] = {}
        self.ends: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text, each without the one space that the model puts before a text."""
        text = text.replace(SIGN, " ")
        return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            new = list({p for p, n in zip(pieces, out, strict=True) if n is None})
            counts = dict(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
            if len(known) < REMEMBERED:
                known.update(counts)
            out = [counts[p] if n is None else n for p, n in zip(pieces, out, strict=True)]
        return out

    def totals(self, texts: list[str]) -> list[int]:
        """Last entries of the prefix tables of many texts: sums of the last entries of their pieces.

        New pieces are worked out together, in order, so that one goes on from the prefix it shares with the one before; the library
        counts them in one call.
        """
        cut = [self.pieces(text) if text else [] for text in texts]
        ends = self.ends
        new = sorted({piece for pieces in cut for piece in pieces if piece not in ends})
        found = {}
        before, count, last = "", [0], [""]
        for piece, whole in zip(new, map(len, self.model.encode(new, num_threads=1)) if new else (), strict=True):
            text = SIGN + piece.replace(" ", SIGN)
            same = next((i for i, (a, b) in enumerate(zip(text, before)) if a != b), min(len(text), len(before)))
            del count[same + 1 :], last[same + 1 :]
            self.extend(text, count, last)
            found[piece] = count[-1] if piece and count[-1] == whole else whole
            before = text
        out = [sum(found[p] if p in found else ends[p] for p in pieces) for pieces in cut]
        if len(ends) + len(found) > REMEMBERED:
            ends.clear()
        ends.update(found)
        return out

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string, by merging the best pair of neighbours as long as there is one."""
        out = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(out[:-1], out[1:], strict=True)) if a + b in self.score), default=None)
            if best is None:
                return out
            k = -best[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    def _ends(self, before: str, token: str) -> bool:
        """Whether ``token`` stays a token of its own after ``before``, or at the start."""
        known = self.apart.get((before, token))
        if known is None:
            known = self.merged(before + token) == ([before, token] if before else [token])
            if len(self.apart) < REMEMBERED:
                self.apart[before, token] = known
        return known

    def _worth(self, token: str) -> int:
        return 1 if token in self.score or not self.bytewise else len(token.encode())

    def recurrence(self, piece: str) -> np.ndarray:
        """Counts of the prefixes of a piece from those of shorter ones."""
        count, last = [0], [""]
        self.extend(SIGN + piece.replace(" ", SIGN), count, last)
        return np.array(count[2:], np.int32)

    def extend(self, text: str, count: list[int], last: list[str]) -> None:
        """Counts and last tokens of the prefixes that ``count`` and ``last`` do not reach yet."""
        for i in range(len(count), len(text) + 1):
            node, n, ending = self.back, 0, [1]
            while n < i and (node := node.get(text[i - 1 - n])) is not None:
                n += 1
                if n > 1 and "" in node:
                    ending.append(n)
            for n in reversed(ending):
                token = text[i - n : i]
                if self._ends(last[i - n], token):
                    break
            last.append(token)
            # Unknown characters side by side are one token if the model does not spell them in bytes.
            joined = not self.bytewise and token not in self.score and last[i - n] and last[i - n] not in self.score
            count.append(count[i - n] + (0 if joined else self._worth(token)))

    def prefix_steps(self, piece: str) -> np.ndarray:
        """Counts of the prefixes of a piece, one for each of its characters."""
        steps = self.steps.get(piece)
        if steps is None:
            steps = self.recurrence(piece)
            if len(piece) and steps[-1] != self.count([piece])[0]:
                each = (piece[: i + 1] for i in range(len(piece)))
                steps = np.fromiter((len(self.model.encode(x)) for x in each), np.int32, len(piece))
            if len(self.steps) < REMEMBERED // 10:
                self.steps[piece] = steps
        return steps

    def prefixes(self, text: str) -> np.ndarray:
        """Entry ``i`` is the token count of the first ``i + 1`` characters."""
        pieces = self.pieces(text) if text else []
        parts, before = [], 0
        for k, (piece, n) in enumerate(zip(pieces, self.count(pieces), strict=True)):
            if k:  # the space between two pieces: a token of its own as long as nothing follows it
                parts.append(np.array([before + self._space(pieces[k - 1])], np.int32))
            parts.append(before + self.prefix_steps(piece))
            before += n
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _space(self, piece: str) -> int:
        both = piece + " "
        return self.count([both])[0] - self.count([piece])[0]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a worker; its counts outlive a task."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _unused(docs: DataFrame, name: str) -> str:
    """A name like this that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _apply(docs: DataFrame, text: str, added: list[tuple[str, str]], work: Callable) -> DataFrame:
    """``docs`` with columns replaced or added; ``work(texts)`` gives the values of each text."""
    names = [n for n, _ in added]
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    own = _unused(docs, "text")
    probe = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias(own))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in added])

    def apply(batches):
        for batch in (s for b in batches for s in slices(b, own)):
            made = zip(*work([t or "" for t in batch.column(own).to_pylist()]), strict=True)
            columns = [pa.array(list(v), pa.int64() if t == "long" else pa.string() if t == "string" else pa.list_(pa.int32())) for v, (_, t) in zip(made, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*(f.name for f in kept), *names])

    return probe.mapInArrow(apply, schema)


def token_totals(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of each whole text, the last value of its prefix table.

    A null or empty text has none. A column of the same name is replaced. Texts are never cut.
    """
    return _apply(docs, text, [(column, "long")], lambda texts: [(n,) for n in model(path).totals(texts)])


def prefix_table(docs: DataFrame, path: str, text: str = "text", column: str = "prefix_tokens") -> DataFrame:
    """``docs`` with an array whose entry ``i`` is the token count of the first ``i + 1`` characters.

    Adding a character may lower a count, when it completes a longer token. A null or empty text has an empty array.
    """
    return _apply(docs, text, [(column, "array<int>")], lambda texts: [(model(path).prefixes(t),) for t in texts])


def tokens_before(prefixes: str, characters) -> F.Column:
    """Token count of the first ``characters`` of a text, from its prefix table."""
    n = F.least(F.lit(characters).cast("int"), F.size(prefixes))
    return F.when(n <= 0, F.lit(0)).otherwise(F.get(F.col(prefixes), n - 1))


def longest_prefix(prefixes: str, budget) -> F.Column:
    """The most characters of a text that together take at most ``budget`` tokens, from its prefix table."""
    fits = F.transform(F.col(prefixes), lambda n, i: F.when(n <= F.lit(budget), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def truncated(docs: DataFrame, path: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with each text cut to the longest prefix of at most ``budget`` tokens; a null stays null."""
    prefixes = _unused(docs, "prefix_tokens")
    table = prefix_table(docs, path, text, prefixes)
    return table.withColumn(text, F.substring(F.col(text), F.lit(1), longest_prefix(prefixes, budget))).drop(prefixes)


def report(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_totals(chosen, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
