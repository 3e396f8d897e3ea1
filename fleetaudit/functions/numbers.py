"""Integer and decimal arithmetic with the rounding rules the audit rules expect."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trunc_int(c, kind: str = "long") -> Column:
    """Cast that drops the fraction."""
    return _col(c).cast(kind)


def percent_of(part, whole, precision: int = 5, scale: int = 2) -> Column:
    """part / whole as a percentage; null when whole is zero or null.

    Twenty digits are the width of the size columns; wider operands would leave the quotient
    six decimals only, and rounding it twice moves the last digit.
    """
    ratio = _col(part).cast("decimal(20,0)") / F.nullif(_col(whole).cast("decimal(20,0)"), F.lit(0))
    return (ratio * 100).cast(f"decimal({precision},{scale})")


def scaled(amount, divisor: int, precision: int = 18, scale: int = 1) -> Column:
    """amount / divisor as a decimal with a fixed scale (pages to MB, bytes to GB)."""
    return (_col(amount).cast("decimal(28,0)") / F.lit(divisor)).cast(f"decimal({precision},{scale})")


def text_of_number(c) -> Column:
    return _col(c).cast("string")
