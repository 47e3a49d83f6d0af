"""Column naming shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def quote(name: str) -> str:
    """``name`` as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def lag_name(target: str, i: int) -> str:
    return f"{target}_l{i}"


def lag_names(targets: Sequence[str], p: int) -> list[str]:
    """Lag columns in feature order: all targets at lag 1, then lag 2, ..."""
    return [lag_name(t, i) for i in range(1, p + 1) for t in targets]


def predict_name(target: str) -> str:
    return f"{target}_Predict"


def target_columns(columns: Iterable[str], time: str, exclude: Iterable[str] = ()) -> list[str]:
    """Every column that is neither the time column nor excluded is a target."""
    skip = {time.lower(), *(c.lower() for c in exclude)}
    return [c for c in columns if c.lower() not in skip]
