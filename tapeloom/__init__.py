"""Tick-event analytics as Spark jobs: clean, order, tokenise, model, label, score and compare."""

from .config import CleanSpec, ClockSpec, SplitSpec, TokenSpec

__all__ = ["CleanSpec", "ClockSpec", "SplitSpec", "TokenSpec"]
