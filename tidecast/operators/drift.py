"""Drift injection: copies of a series whose values move away from the original."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.columns import col, cols

# Growth per step and rounding of both drift forms.
STEP = 0.1
DIGITS = 2
#: Gradual drift of up to so many steps is written out step by step.
UNROLLED = 16
# Parameters of the arithmetic hash below; the factors lie below its modulus.
_MODULUS = 2_147_483_647
_MULTIPLIER = 48_271
_SHIFT = 13
_STEP_FACTOR = 7_919
_COLUMN_FACTOR = 104_729


def _stepped(df: DataFrame, columns: Sequence[str], steps: int, where: Column | None, moved):
    """Each drifting row once per step 1..steps; other rows once, as step 0."""
    last = F.lit(steps)
    drifting = F.sequence(F.lit(1), last)
    if where is not None:
        drifting = F.when(where, drifting).otherwise(F.array(F.lit(0)))
    others = [c for c in df.columns if c not in columns]
    stepped = df.select("*", F.explode(drifting).alias("step"))
    return stepped.select(
        *cols(others),
        "step",
        *[
            F.when(F.col("step") == 0, col(c)).otherwise(moved(i, c)).alias(c)
            for i, c in enumerate(columns)
        ],
    )


def inject_gradual(
    df: DataFrame,
    columns: Sequence[str],
    step: float = STEP,
    steps: int = 3,
    digits: int = DIGITS,
    where: Column | None = None,
) -> DataFrame:
    """``steps`` rows per row; each adds ``step`` once more, rounded every time.

    ``where`` limits the drift to some rows, such as those after a cut time. A step that
    rounding swallows leaves a value where it is, however many are taken.
    """

    def taken(c: str) -> list[Column]:
        """The values after one step, two steps, ..., each from the one before."""
        values = [col(c).cast("double")]
        for _ in range(steps):
            values.append(F.round(values[-1] + F.lit(step), digits))
        return values[1:]

    def folded(_: int, c: str) -> Column:
        start = col(c).cast("double")
        return F.aggregate(F.sequence(F.lit(1), F.col("step")), start, lambda x, _: F.round(x + F.lit(step), digits))

    if steps > UNROLLED:
        return _stepped(df, columns, steps, where, folded)
    # Compiled, and once for each row rather than for each of its copies.
    arrays = {c: f"__taken_{i}" for i, c in enumerate(columns)}
    before = df.select("*", *[F.array(*taken(c)).alias(a) for c, a in arrays.items()])
    stepped = _stepped(before, columns, steps, where, lambda _, c: F.element_at(arrays[c], F.col("step")))
    return stepped.drop(*arrays.values())


def jump(key: Column, column: int, step: Column, seed: int) -> Column:
    """A number 1..10 that depends only on the row key, column, step and seed.

    Plain arithmetic instead of a random generator: the result is the same
    under any partitioning and when a lost task is run again.
    """
    modulus = F.lit(_MODULUS).cast("bigint")
    salt = F.lit(seed + column * _COLUMN_FACTOR).cast("bigint") + step * _STEP_FACTOR
    mixed = F.pmod(key, modulus)
    for _ in range(2):
        mixed = F.pmod(mixed * _MULTIPLIER + salt, modulus)
        # Without a step that is not linear the columns would jump alike.
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, _SHIFT))
    return F.pmod(mixed, F.lit(10).cast("bigint")) + 1


def inject_abrupt(
    df: DataFrame,
    columns: Sequence[str],
    key: Column,
    seed: int = 0,
    steps: int = 1,
    step: float = STEP,
    digits: int = DIGITS,
    where: Column | None = None,
) -> DataFrame:
    """``steps`` rows per row; each adds ``step`` times a number 1..10 per value.

    ``key`` is an integer that identifies the row. The jumps of later steps
    come on top of those of earlier ones.
    """
    integer_key = key.cast("bigint")

    def moved(i: int, c: str) -> Column:
        value = col(c)
        total = value
        for s in range(1, steps + 1):
            next_total = F.round(total + F.lit(step) * jump(integer_key, i, F.lit(s), seed), digits)
            total = next_total if s == 1 else F.when(F.col("step") >= s, next_total).otherwise(total)
        return total

    return _stepped(df, columns, steps, where, moved)
