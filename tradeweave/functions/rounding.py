"""Exact rounding of means, shares and ratios.

Averaging decimals in floating point makes the last printed digit depend on the
engine and on the order rows arrive in.  Every mean here is a ratio of two exact
integers (cents, days, counts), rounded half away from zero in integer arithmetic.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def cents(amount: Column | str) -> Column:
    """Money with two decimals as a whole number of cents."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * 100).cast(WIDE)


def ratio(
    num: Column | str, den: Column | str, places: int, shift: int = 0, *, signed: bool = False
) -> Column:
    """``num * 10**shift / den`` rounded to ``places`` decimals; null unless ``den`` > 0.

    ``num`` and ``den`` hold whole numbers; ``signed`` is needed where ``num`` may be
    negative.  The expression is kept short because Spark compiles it for every use.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    power = places + shift
    n = (F.abs(num) if signed else num).cast(WIDE) * (2 * 10 ** max(power, 0))
    d = den.cast(WIDE) * 10**-power if power < 0 else den.cast(WIDE)
    steps = F.when(den > 0, F.call_function("div", n + d, d * 2))
    if signed:
        steps = F.when(num < 0, -steps).otherwise(steps)
    return steps.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-places))


def percent(
    num: Column | str, den: Column | str, places: int = 2, *, signed: bool = False
) -> Column:
    return ratio(num, den, places, shift=2, signed=signed)


def mean_money(total_cents: Column | str, n: Column | str) -> Column:
    """Mean of an amount, in currency units with two decimals."""
    return ratio(total_cents, n, 2, shift=-2)
