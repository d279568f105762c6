"""Amounts and ratios.

Totals of money are exact: they do not depend on the order in which partitions arrive or on a
task being run again. Results are handed back as doubles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals an amount is expected to carry, and how many more are kept if it carries them.
DECIMALS = 4
FINER = 8
LOW_BITS = 20

# Fixed values of the price formula.
ONE_WAY_FEE_USD = 75.0
TAX_RATE = 0.135


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def exact_sum(column: str | Column, decimals: int = DECIMALS) -> Column:
    """Total as a decimal; amounts carry up to ``decimals`` decimals, NaN counts as missing.

    Amounts are added as whole units of that size, which stays in generated code and is several
    times faster than adding decimals. High and low bits are added apart, so the total may
    exceed what one long can hold. What an amount holds beyond its units is added as well, to
    eight more decimals; an amount of 2^62 units or more stops the query.
    """
    amount = _col(column).cast("double")
    scaled = F.nanvl(amount, F.lit(None).cast("double")) * 10**decimals
    units = F.floor(scaled + 0.5)
    held = F.when(
        F.abs(scaled) >= float(2**62), F.raise_error(F.concat(F.lit("amount too large to add: "), amount.cast("string"))).cast("long")
    ).otherwise(units)
    # A double that means a whole number of units misses it by its last bits; that is no amount.
    beyond = scaled - units
    rest = F.when(F.abs(beyond) > F.greatest(F.lit(1e-7), F.abs(scaled) * 2.0**-50), F.floor(beyond * 10**FINER + 0.5)).otherwise(F.lit(0))
    high = F.sum(F.shiftright(held, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(held.bitwiseAND(F.lit(2**LOW_BITS - 1))).cast("decimal(20,0)")
    whole = high * F.lit(2**LOW_BITS) + low
    unit = F.lit(Decimal(1).scaleb(-decimals))
    finer = F.sum(F.when(scaled.isNotNull(), rest)).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-FINER))
    return ((whole + finer) * unit).cast(f"decimal(38,{decimals + FINER})")


def usd_sum(column: str | Column) -> Column:
    """Total rounded half-up to cents."""
    return F.round(exact_sum(column), 2).cast("double")


def usd_avg(column: str | Column) -> Column:
    """Mean over the non-null amounts, rounded half-up to cents."""
    mean = exact_sum(column).cast("double") / _nonzero(F.count(_col(column)))
    return F.round(mean, 2)


def _nonzero(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero or null."""
    return numerator / _nonzero(denominator)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` on a 0-100 scale.

    Multiplied before it is divided, so that the quotient is off by no more than its last bit
    and a value such as 1.85 rounds up.
    """
    return F.round(safe_div(part * F.lit(100.0), whole), digits)


def base_price(daily_rate: Column, days: Column) -> Column:
    return F.round(daily_rate * days, 2)


def one_way_fee(is_one_way: Column) -> Column:
    return F.when(is_one_way, F.lit(ONE_WAY_FEE_USD)).otherwise(F.lit(0.0))


def taxes(base: Column, fee: Column) -> Column:
    return F.round((base + fee) * F.lit(TAX_RATE), 2)


def price_columns(daily_rate: Column, days: Column, is_one_way: Column) -> dict[str, Column]:
    """The four amounts of a payment: base, one-way fee, taxes and total."""
    base, fee = base_price(daily_rate, days), one_way_fee(is_one_way)
    tax = taxes(base, fee)
    return {
        "base_amount_usd": base,
        "one_way_fee_usd": fee,
        "taxes_fees_usd": tax,
        "total_amount_usd": F.round(base + fee + tax, 2),
    }


def display_usd(column: str | Column, digits: int = 0) -> Column:
    """Text such as ``$1,234`` or ``($1,234)``, for the last step before a reader."""
    col = _col(column)
    text = F.concat(F.lit("$"), F.format_number(F.abs(col), digits))
    return F.when(col < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def display_percent(ratio: str | Column, digits: int = 1) -> Column:
    """Text such as ``12.5%`` from a 0-1 ratio."""
    return F.concat(F.format_number(_col(ratio) * 100, digits), F.lit("%"))


def display_number(column: str | Column, digits: int = 0) -> Column:
    """Text such as ``1,234.5``."""
    return F.format_number(_col(column), digits)
