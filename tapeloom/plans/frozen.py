"""Scoring of new prints with stored parameters only: nothing is fitted here.

Everything that was fitted travels as one bundle: edges and centres of the bins, thresholds of the tasks, the probes, and the settings they
were fitted under. Its digest is checked when it is opened.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanSpec, ClockSpec, TokenSpec
from ..operators import clean, clock, events, labels, probes, tokens
from ..operators.integrity import settings_digest
from ..runtime import land
from ..sources.files import exists, staged


@dataclass(frozen=True)
class Bundle:
    binner: tokens.Binner
    thresholds: dict[str, tuple[float, float]]
    heads: dict[str, probes.Probe]
    features: tuple[str, ...]
    token_spec: TokenSpec
    clock_spec: ClockSpec
    clean_spec: CleanSpec

    def plain(self) -> dict:
        """Lists and numbers only, as JSON gives them back."""
        return json.loads(json.dumps(dataclasses.asdict(self)))


def _restored(kind, values: dict):
    """A dataclass from its plain values: lists are tuples there."""
    tupled = lambda v: tuple(map(tupled, v)) if isinstance(v, list) else v
    return kind(**{name: tupled(v) for name, v in values.items()})


def write_bundle(spark: SparkSession, bundle: Bundle, path: str, mode: str = "errorifexists") -> str:
    """Publish the bundle whole and return its digest."""
    content = bundle.plain()
    digest = settings_digest(content)
    with staged(spark, path, mode) as beside:
        spark.createDataFrame([(json.dumps({"content": content, "digest": digest}, sort_keys=True),)], "value string").coalesce(1).write.text(beside)
    return digest


def open_bundle(spark: SparkSession, path: str, digest: str | None = None) -> Bundle:
    """The stored bundle; one that was changed, or another than the named one, is refused."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    stored = json.loads(spark.read.text(path).first().value)
    found = settings_digest(stored["content"])
    if found != stored["digest"] or digest not in (None, found):
        raise ValueError(f"The bundle at {path} differs from its digest")
    c = stored["content"]
    return Bundle(
        _restored(tokens.Binner, c["binner"]), {t: tuple(v) for t, v in c["thresholds"].items()}, {n: _restored(probes.Probe, h) for n, h in c["heads"].items()},
        tuple(c["features"]), _restored(TokenSpec, c["token_spec"]), _restored(ClockSpec, c["clock_spec"]), _restored(CleanSpec, c["clean_spec"]),
    )


@dataclass(frozen=True)
class Applied:
    """New sessions under an old bundle: coded events and labelled anchors, both read from trades that were numbered and landed once."""

    bundle: Bundle
    trades: DataFrame
    coded: DataFrame
    labelled: DataFrame

    def score(self, head: str) -> DataFrame:
        """Probabilities of an old probe for the new anchors, next to the context tokens they saw."""
        seen = labels.context_codes(self.labelled, self.coded, self.bundle.token_spec.context, last="last_code_index")
        ready = self.labelled.join(seen, ["symbol", "date", "anchor"]).withColumn("x", F.array(*self.bundle.features))
        return probes.predict_probe(ready, self.bundle.heads[head])


def apply_frozen(kept: DataFrame, bundle: Bundle) -> Applied:
    """Cleaned prints of new sessions by old edges and thresholds. Ordering and numbering them is one pass."""
    context = bundle.token_spec.context
    numbered = events.event_features(events.number_trades(kept)).where(F.col("trades") - 1 > context)
    trades = land(numbered, "frozen-trades")
    coded = tokens.tokenise(events.events_of(trades), bundle.binner)
    marked = land(clock.marked_anchors(trades, events.all_sessions(trades), bundle.clock_spec, bundle.clean_spec, context), "frozen-anchors")
    found = clock.clock_examples(marked, bundle.clock_spec)
    return Applied(bundle, trades, coded, clock.apply_thresholds(found, bundle.thresholds))


def score_raw(raw: DataFrame, bundle: Bundle, split, head: str) -> DataFrame:
    """Raw prints to probabilities: cleaned by the bundle's settings and the calendar ``split``, then scored."""
    return apply_frozen(clean.retained(clean.annotate(raw, bundle.clean_spec, split)), bundle).score(head)
