"""Does quantity times price give the amount? Tolerance profiles, and arithmetic over documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Absolute and relative tolerance by use. They differ on purpose.
PROFILES: dict[str, tuple[float, float]] = {
    "evidence": (0.03, 0.003),
    "gate": (0.06, 0.005),
    "authority": (0.08, 0.01),
    "signature": (0.02, 0.001),
    "line_audit": (0.02, 0.0005),
    "consensus": (0.03, 0.002),
    "strict": (0.02, 0.0),
    "save": (0.06, 0.0),
    "document_total": (0.05, 0.0001),
    "line_sum": (0.05, 0.0005),
    "subtotal_score": (0.05, 0.004),
    "subtotal_accept": (0.06, 0.002),
}


def complete(q: Column, p: Column, a: Column) -> Column:
    return F.coalesce((q > 0) & p.isNotNull() & a.isNotNull(), F.lit(False))


def within(value: Column, expected: Column, profile: str) -> Column:
    absolute, rate = PROFILES[profile]
    return F.abs(value - expected) <= F.greatest(F.lit(absolute), F.abs(expected) * F.lit(rate))


def econ_ok(q: Column, p: Column, a: Column, profile: str = "evidence") -> Column:
    """False for incomplete rows: arithmetic that cannot be checked is not verified."""
    return complete(q, p, a) & F.coalesce(within(q * p, a, profile), F.lit(False))


def half_up_2(x: Column) -> Column:
    """Two decimals, halves up, on doubles: floor(100 x + 0.5) / 100."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def derived_quantity(p: Column, a: Column) -> Column:
    """amount / price where it is within 0.01 of a whole number above zero; null otherwise."""
    q = F.try_divide(a, p)
    return F.when((F.round(q) > 0) & (F.abs(q - F.round(q)) <= 0.01), F.round(q))


def third_of_three(q: Column, p: Column, a: Column) -> Column:
    """The one missing of quantity, price and amount; a struct, with the others as they are. Two missing stay missing."""
    return F.struct(
        F.when(q.isNull() & p.isNotNull() & a.isNotNull(), derived_quantity(p, a)).otherwise(q).alias("quantity"),
        F.when(p.isNull() & (q > 0) & a.isNotNull(), half_up_2(a / q)).otherwise(p).alias("unit_price"),
        F.when(a.isNull() & q.isNotNull() & p.isNotNull(), half_up_2(q * p)).otherwise(a).alias("amount"),
    )
