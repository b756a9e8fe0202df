"""Named buckets over numeric columns."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweave import labels as L


def up_to(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """Name of the first step whose limit is not below ``value``, else ``rest``."""
    chain = F
    for limit, name in steps:
        chain = chain.when(value <= limit, F.lit(name))
    return chain.otherwise(F.lit(rest))


def below(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """Name of the first step whose limit is above ``value``, else ``rest``."""
    chain = F
    for limit, name in steps:
        chain = chain.when(value < limit, F.lit(name))
    return chain.otherwise(F.lit(rest))


def at_least(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """Name of the first step whose limit is not above ``value``, else ``rest``."""
    chain = F
    for limit, name in steps:
        chain = chain.when(value >= limit, F.lit(name))
    return chain.otherwise(F.lit(rest))


def pick(position: Column, names: Sequence[str]) -> Column:
    """The name at a 1-based position."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def installment_bucket(n: Column) -> Column:
    """Payment plan; 0 and null count as the open-ended plan."""
    return F.when(n >= 1, up_to(n, L.INSTALLMENT_BUCKETS, L.INSTALLMENT_REST)).otherwise(
        F.lit(L.INSTALLMENT_REST)
    )


def weight_bucket(grams: Column) -> Column:
    return up_to(grams, L.WEIGHT_BUCKETS, L.WEIGHT_REST)


def delivery_bucket(days_early: Column) -> Column:
    """Delivery against the promise in whole days, positive = early; exactly -5 is slightly late."""
    return at_least(days_early, L.DELIVERY_BUCKETS, L.DELIVERY_REST)


def delivery_cut(days_early: Column) -> Column:
    """Right-closed variant: exactly -5 is very late, beyond +-999 is null."""
    chain = F
    for low, high, name in L.DELIVERY_CUTS:
        chain = chain.when((days_early > low) & (days_early <= high), F.lit(name))
    return chain


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Customer segment from the three 1-5 scores, decided by recency band first."""
    recent = F.when((f >= 4) & (m >= 4), L.CHAMPIONS).when(f >= 3, L.LOYAL).otherwise(L.NEW)
    middling = F.when((f >= 3) & (m >= 3), L.POTENTIAL).otherwise(L.NEED_ATTENTION)
    distant = F.when(f >= 3, L.AT_RISK).when(m >= 3, L.CANT_LOSE).otherwise(L.LOST)
    return F.when(r >= 4, recent).when(r == 3, middling).otherwise(distant)
