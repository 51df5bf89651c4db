"""Raw prints to landed trades, sessions and fitted bins: the part every later question shares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanSpec, ClockSpec, SplitSpec, TokenSpec
from ..operators import clean, clock, events, labels, tokens, windows
from ..runtime import land
from ..sources.files import stamp
from . import tape

HORIZON = 4
BAND = 8000.0


@dataclass
class Prepared:
    """One tape under one set of settings. Tables are landed once and read back with pruned columns."""

    marked: DataFrame
    clean_spec: CleanSpec
    split_spec: SplitSpec
    token_spec: TokenSpec
    clock_spec: ClockSpec
    missing: str = "error"
    column_warnings: tuple[str, ...] = ()
    made: dict = field(default_factory=dict, repr=False)

    def once(self, name: str, make: Callable):
        """A result of this tape that several questions share, made on first use."""
        if name not in self.made:
            self.made[name] = make(self)
        return self.made[name]

    def landed(self, name: str, make: Callable[[Prepared], DataFrame]) -> DataFrame:
        """The same for a table, which is landed in the shared folder."""
        return self.once(name, lambda p: land(make(p), name))

    @property
    def spark(self) -> SparkSession:
        return self.marked.sparkSession

    @property
    def context(self) -> int:
        return self.token_spec.context

    @property
    def vocab(self) -> int:
        return self.token_spec.vocab

    @cached_property
    def tape(self) -> DataFrame:
        """Every print with its parsed fields and first failed filter, landed, so that the raw text is parsed once for cleaning and
        audit alike; a mix of zoned and naive times is refused."""
        marked, kinds = clean.watched(self.marked)
        tape = land(marked, "tape")
        clean.refuse_mix(kinds.get)
        return tape

    @property
    def kept(self) -> DataFrame:
        return clean.retained(self.tape)

    @cached_property
    def trades(self) -> DataFrame:
        return land(events.event_features(events.number_trades(self.kept)), "trades")

    @cached_property
    def sessions(self) -> DataFrame:
        """Usable sessions. A split without any is refused, and so are expected ones that are missing, unless they are to be skipped."""
        sessions = land(events.session_table(self.trades, self.context), "sessions")
        self.made["warnings"] = events.require_sessions(sessions, self.split_spec, self.missing)
        events.check_splits(sessions)
        return sessions

    @property
    def report(self) -> DataFrame:
        """The audit with all warnings: repeats, columns that were lacking, and sessions that were skipped or too short."""
        return self.audit()

    def audit(self, warn_of_repeats: bool = True) -> DataFrame:
        self.sessions  # noqa: B018 - sees to its warnings
        n = events.short_sessions(self.trades, self.context).count()
        short = [f"{n} sessions have too few events and were dropped"] if n else []
        return clean.audit(self.tape, [*self.column_warnings, *self.made["warnings"], *short], warn_of_repeats)

    @cached_property
    def usable_trades(self) -> DataFrame:
        return self.trades.where(F.col("trades") - 1 > self.context)

    @cached_property
    def events(self) -> DataFrame:
        return events.events_of(self.trades, self.context)

    @property
    def train(self) -> DataFrame:
        return self.events.where("split = 'train'")

    @cached_property
    def binner(self) -> tokens.Binner:
        return tokens.fit_bins(self.train, self.token_spec.bins)

    @cached_property
    def coded(self) -> DataFrame:
        return tokens.tokenise(self.events, self.binner)

    @cached_property
    def examples(self) -> DataFrame:
        """Event-time examples of all splits with their dense index."""
        found = labels.event_examples(self.events, self.context, HORIZON, BAND)
        totals = labels.example_totals(self.sessions, self.context, HORIZON)
        return land(labels.index_examples(found, totals), "examples")

    @cached_property
    def anchors(self) -> DataFrame:
        """Candidate clock anchors with their boundary states."""
        marked = clock.marked_anchors(self.usable_trades, self.sessions, self.clock_spec, self.clean_spec, self.context)
        return land(marked, "anchors")

    @cached_property
    def clock_examples(self) -> DataFrame:
        return clock.clock_examples(self.anchors, self.clock_spec)

    @cached_property
    def thresholds(self) -> dict[str, tuple[float, float]]:
        return clock.fit_thresholds(self.clock_examples)

    @cached_property
    def clock_labels(self) -> DataFrame:
        return clock.apply_thresholds(self.clock_examples, self.thresholds)

    @cached_property
    def counts(self) -> DataFrame:
        return windows.window_counts(self.sessions, self.context)


_prepared: dict[tuple, Prepared] = {}


def prepare(
    prints: DataFrame, clean_spec: CleanSpec, split_spec: SplitSpec, token_spec: TokenSpec, clock_spec: ClockSpec, missing: str = "error"
) -> Prepared:
    """``missing`` says what becomes of expected sessions that are missing or too short: ``error`` or ``skip``."""
    if missing not in events.POLICIES:
        raise ValueError("The policy is error or skip")
    warnings = clean.check_columns(clean.normalize_columns(prints), clean_spec)
    return Prepared(clean.annotate(prints, clean_spec, split_spec), clean_spec, split_spec, token_spec, clock_spec, missing, tuple(warnings))


def prepared_tape(spark: SparkSession, sf_dir: str, token_spec: TokenSpec = tape.TOKENS) -> Prepared:
    """The tape of ``sf_dir``, prepared once per application and state of its files: changed input is prepared anew."""
    key = (spark.sparkContext.applicationId, sf_dir, token_spec, stamp(spark, f"{sf_dir}/events.parquet"))
    if key not in _prepared:
        for old in [k for k in _prepared if k[:3] == key[:3]]:
            del _prepared[old]
        prints = tape.raw_prints(spark, sf_dir)
        _prepared[key] = prepare(prints, tape.CLEAN, tape.SPLIT, token_spec, tape.CLOCK, missing="skip")
    return _prepared[key]
