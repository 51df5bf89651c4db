"""Every operator as a question over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle import ask, ask_clock
from .prepare import prepared_tape

PLACES = 6


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: whole numbers as BIGINT, reals rounded, dates as text."""

    def plain(field):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            # Adding zero turns a rounded -0.0 into 0.0.
            column = F.round(column.cast("double"), PLACES) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema])


def cols(spec: str) -> str:
    """Select list from ``name``, ``name:i`` (whole number) and ``name:r`` (rounded real)."""
    kinds = {"i": "CAST({0} AS BIGINT) AS {0}", "r": f"round(CAST({{0}} AS DOUBLE), {PLACES}) + 0.0 AS {{0}}"}
    out = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        out.append(kinds[kind].format(name) if kind else name)
    return ", ".join(out)


@dataclass(frozen=True)
class Question:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUESTIONS: dict[str, Question] = {}


def question(result: str | None = None, source: str = "", *more: str, clock: bool = False, raw: bool = False):
    """Register a function of the prepared tape (or, ``raw``, of session and folder) under its own name.

    ``result`` lists the columns as :func:`cols` reads them and ``source`` is the SQL that has them.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir) if raw else fn(prepared_tape(spark, sf_dir)))

        sql = None
        if result is not None:
            sql = (ask_clock if clock else ask)(f"SELECT {cols(result)} FROM ({source})", *more)
        QUESTIONS[fn.__name__] = Question(run, sql)
        return fn

    return register
