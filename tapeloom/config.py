"""Settings for every operator: plain frozen dataclasses, validated when they are made."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

SPLITS = ("train", "val", "test", "heldout")
KEY = ("symbol", "date")
FIELDS = ("interval", "price", "size")


def clock_seconds(text: str) -> int:
    hours, minutes, seconds = (int(part) for part in text.split(":"))
    return hours * 3600 + minutes * 60 + seconds


@dataclass(frozen=True)
class CleanSpec:
    # Published column names, code lists and exchange hours.
    symbol_column: str = "symbol"
    root_column: str = "sym_root"
    suffix_column: str = "sym_suffix"
    timestamp_column: str = "timestamp"
    date_column: str = "date"
    time_column: str = "time_m"
    price_column: str = "price"
    size_column: str = "size"
    correction_column: str = "tr_corr"
    condition_column: str = "tr_scond"
    seq_column: str = "seq"
    timezone: str = "America/New_York"
    session_start: str = "09:30:00"
    session_end: str = "16:00:00"
    allowed_corrections: tuple[str, ...] = ("0", "00")
    allowed_conditions: tuple[str, ...] = ("", "@", "@F", "@  I", "@F I")
    require_quality_fields: bool = True

    def __post_init__(self):
        if clock_seconds(self.session_start) >= clock_seconds(self.session_end):
            raise ValueError("session_start must come before session_end")

    @property
    def session_seconds(self) -> int:
        return clock_seconds(self.session_end) - clock_seconds(self.session_start)


@dataclass(frozen=True)
class SplitSpec:
    """Seen symbols are split by date; held-out symbols count on test dates only."""

    seen: tuple[str, ...]
    heldout: tuple[str, ...]
    train: tuple[str, ...]
    val: tuple[str, ...]
    test: tuple[str, ...]

    def __post_init__(self):
        if set(self.seen) & set(self.heldout):
            raise ValueError("A symbol cannot be both seen and held out")
        dates = [*self.train, *self.val, *self.test]
        if len(dates) != len(set(dates)):
            raise ValueError("A date belongs to one split only")

    def symbols(self) -> list[tuple[str, bool]]:
        """Each symbol and whether it is held out."""
        return [(symbol, False) for symbol in self.seen] + [(symbol, True) for symbol in self.heldout]


@dataclass(frozen=True)
class TokenSpec:
    bins: int = 8
    context: int = 128

    def __post_init__(self):
        if self.bins < 2 or self.context < 1:
            raise ValueError("Need at least two bins and one context event")

    @property
    def vocab(self) -> int:
        return self.bins**3


@dataclass(frozen=True)
class ClockSpec:
    """Times are whole units of ``unit_ns``; the defaults are one-second units of a 6.5 hour session."""

    unit_ns: int = 1_000_000_000
    session_units: int = 23_400
    step: int = 40
    history: int = 300
    recent: tuple[int, int] = (5, 30)
    activity: int = 10
    volatility: int = 30
    vwap_from: int = 25
    vwap_to: int = 35
    trail: int = 10
    max_age: float = 5.0
    rv_floor: float = 1e-16
    older_lag: int = 20


def settings(*specs) -> dict:
    return {type(spec).__name__: dataclasses.asdict(spec) for spec in specs}
