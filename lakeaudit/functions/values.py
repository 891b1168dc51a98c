"""Column functions for money, narrow integers and event times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2026-01-01T00:00:00Z and one hour, in milliseconds.
REPLAY_EPOCH_MS = 1_767_225_600_000
STEP_MS = 3_600_000


def to_money(value: Column) -> Column:
    """A float as decimal(18,2) by way of its text; digits beyond the second are cut off, not rounded."""
    exact = value.cast("string").cast("decimal(38,17)")
    cut = F.when(exact < 0, F.ceil(exact, F.lit(2))).otherwise(F.floor(exact, F.lit(2)))
    return cut.cast("decimal(18,2)")


def money_minus(a: Column, b: Column) -> Column:
    """A difference of money stays decimal(18,2)."""
    return (a - b).cast("decimal(18,2)")


def unsigned(value: Column, bits: int) -> Column:
    """The value modulo 2**bits, as a narrowing to an unsigned type gives it; bits up to 32."""
    return F.pmod(value.cast("long"), F.lit(1 << bits)).cast("int" if bits < 32 else "long")


def event_time_ms(step: Column, ordinal: Column, rows_in_step: Column) -> Column:
    """Rows of a step spread evenly over its hour, in order (X6). Null outside the bounds step >= 1, 0 <= ordinal < rows."""
    fine = (step >= 1) & (rows_in_step >= 1) & (ordinal >= 0) & (ordinal < rows_in_step)
    ahead = ordinal.cast("long") * STEP_MS
    offset = ((ahead - F.pmod(ahead, rows_in_step.cast("long"))) / rows_in_step.cast("long")).cast("long")
    return F.when(fine, F.lit(REPLAY_EPOCH_MS) + (step.cast("long") - 1) * STEP_MS + offset)
