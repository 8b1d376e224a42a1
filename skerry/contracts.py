"""Argument checks; all raise ValueError."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any


def option(value: Any, options: Iterable, name: str = "value") -> Any:
    options = list(options)
    if value not in options:
        raise ValueError(f"{name} must be one of {options}, not {value!r}")
    return value


def number(value: Any, lower: float | None = None, upper: float | None = None, lower_inclusive: bool = True, upper_inclusive: bool = True, name: str = "value") -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number, not {value!r}")
    if lower is not None and (value < lower or value == lower and not lower_inclusive):
        raise ValueError(f"{name} must be {'at least' if lower_inclusive else 'above'} {lower}, not {value}")
    if upper is not None and (value > upper or value == upper and not upper_inclusive):
        raise ValueError(f"{name} must be {'at most' if upper_inclusive else 'below'} {upper}, not {value}")
    return value


def whole(value: Any, lower: float | None = None, upper: float | None = None, lower_inclusive: bool = True, upper_inclusive: bool = True, name: str = "value") -> int:
    number(value, lower, upper, lower_inclusive, upper_inclusive, name)
    if int(value) != value:
        raise ValueError(f"{name} must be a whole number, not {value}")
    return int(value)


def columns(df, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
