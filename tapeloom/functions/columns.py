"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_of(root: Column, suffix: Column | None = None) -> Column:
    """``ROOT`` or ``ROOT.SUFFIX``: share classes stay apart."""
    stem = F.trim(root)
    if suffix is None:
        return stem
    tail = F.trim(F.coalesce(suffix, F.lit("")))
    return F.concat(stem, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))


def quality_code(column: Column, numeric_text: bool = False) -> Column:
    """Null becomes the empty code; ``numeric_text`` also drops the ``.0`` of codes once read as floats."""
    text = F.trim(F.coalesce(column.cast("string"), F.lit("")))
    return F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text) if numeric_text else text


def to_number(column: Column, is_text: bool) -> Column:
    """Double or null. Spark would read a Java suffix such as ``1d``; that is no number here."""
    number = column.try_cast("double")
    if is_text:
        number = F.when(~F.right(F.trim(column), F.lit(1)).isin("d", "D", "f", "F"), number)
    return number


def positive(number: Column) -> Column:
    return (number > 0) & ~F.isnan(number) & (number < float("inf"))


def joint_encode(codes: Sequence[Column], bins: int) -> Column:
    first, second, third = codes
    return ((first * bins + second) * bins + third).cast("int")


def joint_decode(token: Column, bins: int) -> list[Column]:
    return [
        F.floor(token / (bins * bins)).cast("int"),
        (F.floor(token / bins) % bins).cast("int"),
        (token % bins).cast("int"),
    ]


def seq_encode(events: Column, bins: int, order: Sequence[int] = (0, 1, 2)) -> Column:
    """Array of ``[c0, c1, c2]`` to a flat token array; each field owns one block of ``bins`` tokens."""
    return F.flatten(
        F.transform(events, lambda event: F.array(*[(event[f] + f * bins).cast("int") for f in order]))
    )


def seq_decode(tokens: Column, bins: int, order: Sequence[int] = (0, 1, 2)) -> Column:
    """Inverse of :func:`seq_encode`; a wrong length or a token outside its field's block is an error."""

    def field(start: Column, f: int) -> Column:
        code = F.get(tokens, (start + list(order).index(f)).cast("int")) - f * bins
        return F.when((code >= 0) & (code < bins), code).otherwise(
            F.raise_error(F.lit("Token outside the block of its field")).cast("int")
        )

    events = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3, F.lit(3)), lambda start: F.array(*[field(start, f) for f in range(3)])
    )
    empty = F.array().cast("array<array<int>>")
    return (
        F.when(F.size(tokens) % 3 != 0, F.raise_error(F.lit("Token count is not a multiple of 3")).cast("array<array<int>>"))
        .when(F.size(tokens) == 0, empty)
        .otherwise(events)
    )


def draw(*parts: Column) -> Column:
    """Uniform integer in [0, 2**32) fixed by its parts: the first 8 hex digits of an md5."""
    text = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def first_argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def search(value: Column, edges: Sequence[float], leaf: Callable[[int], Column]) -> Column:
    """``leaf(k)`` for ``k`` ascending edges at or below ``value``, as a binary tree of comparisons.

    A sum of comparisons would grow past what the JVM compiles; the tree takes log2 steps.
    """

    def between(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(float(edges[middle])), between(middle + 1, high)).otherwise(between(low, middle))

    return F.when(value.isNotNull(), between(0, len(edges)))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below ``value``: a tie with an edge goes up."""
    return search(value, edges, F.lit).cast("int")
