"""Bucket ranges as columns.

A :class:`Bucketizer` gives the lower end of a value's bucket, and the upper end
as a function of the lower one: grouping uses ``lo`` only and ``hi`` is worked
out once per group instead of once per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the open-ended buckets of the event quantizers (signed 64 bit).
LOWEST = -9223372036854775808.0
HIGHEST = 9223372036854775807.0


@dataclass(frozen=True)
class Bucketizer:
    lo: Callable[[Column], Column]
    hi: Callable[[Column], Column]

    def __call__(self, v: Column) -> Range:
        return Range(self.lo(v), self.hi)


@dataclass(frozen=True)
class Range:
    """``lo`` of a value; apply ``hi_of`` to a *column* that holds it.

    Nesting the whole ``lo`` expression in ``hi_of`` would repeat it in each of
    its comparisons.
    """

    lo: Column
    hi_of: Callable[[Column], Column]


def _powers(base: int) -> list[tuple[int, float]]:
    """Exponents and powers up to the first one above all 64-bit numbers."""
    out = [(0, 1.0)]
    while out[-1][1] <= 2.0**64:
        out.append((out[-1][0] + 1, out[-1][1] * base))
    return out


def _log_guess(v: Column, base: int) -> Column:
    """Exponent for values above the ladder, corrected against the power itself:
    a floating logarithm may miss exact powers."""
    power = lambda e: F.pow(F.lit(float(base)), e)
    k = F.floor(F.log(v) / F.log(F.lit(float(base))))
    return F.when(power(k + 1) <= v, k + 1).when(power(k) > v, k - 1).otherwise(k).cast("double")


def log_floor(v: Column, base: int) -> Column:
    """Largest k with ``base**k <= v`` for v >= 1.

    A ladder of literal comparisons: exact at the powers, and several times
    faster in generated code than logarithm and power functions.
    """
    v = v.cast("double")
    out = None
    for exponent, power in _powers(base):
        item = F.lit(float(exponent))
        limit = F.lit(power * base)
        out = F.when(v < limit, item) if out is None else out.when(v < limit, item)
    return out.otherwise(_log_guess(v, base))


def linear(step: float) -> Bucketizer:
    """``[floor(v/step)*step, +step-1]``."""
    width = float(step)
    return Bucketizer(
        lambda v: F.floor(v / F.lit(width)).cast("double") * F.lit(width),
        lambda lo: lo + F.lit(width - 1),
    )


def _by_power(v: Column, first: Column, base: int, low: int, high: int, arm: Callable[[float], Column]) -> Column:
    """``first`` below ``base**low``, then ``arm(base**k)`` per power up to ``high``.

    One comparison per power with everything else literal: several ladders in
    one expression would outgrow what the JVM compiles to native code.
    """
    out = F.when(v < F.lit(float(base) ** low), first)
    for k in range(low, high + 1):
        out = out.when(v < F.lit(float(base) ** (k + 1)), arm(float(base) ** k))
    return out


def log_linear(base: int, low: int, high: int, n: int) -> Bucketizer:
    """``n`` equal steps per power of ``base``; one bucket under ``base**low``.

    ``high`` is the largest power expected; larger values get their bucket too.
    """
    smallest = float(base) ** low

    def start(v: Column, order: float) -> Column:
        step = F.lit(order * base / n)
        return F.lit(order) + F.floor((v - F.lit(order)) / step).cast("double") * step

    def lo(v: Column) -> Column:
        v = v.cast("double")
        order = F.pow(F.lit(float(base)), _log_guess(v, base))
        step = order * F.lit(float(base)) / F.lit(float(n))
        above = order + F.floor((v - order) / step).cast("double") * step
        return _by_power(v, F.lit(0.0), base, low, high, lambda order: start(v, order)).otherwise(above)

    def hi(lo: Column) -> Column:
        def end(order: float) -> Column:
            step = order * base / n
            return lo + F.lit(step) - F.lit(step / base)

        step = F.pow(F.lit(float(base)), _log_guess(lo, base)) * F.lit(float(base)) / F.lit(float(n))
        above = lo + step - step / F.lit(float(base))
        return _by_power(lo, F.lit(smallest), base, low, high, end).otherwise(above)

    return Bucketizer(lo, hi)


def event_log_linear(base: int, low: int, high: int, n: int) -> Bucketizer:
    """Integer log-linear buckets with an inclusive upper bound.

    One bucket below ``base**low`` and one at or above ``base**(high+1)``.
    """
    smallest, ceiling = float(base**low), float(base ** (high + 1))

    def step_of(order: float) -> float:
        return max(1.0, order * base / n)

    def start(v: Column, order: float) -> Column:
        step = F.lit(step_of(order))
        return F.lit(order) + F.floor((v - F.lit(order)) / step).cast("double") * step

    def lo(v: Column) -> Column:
        v = v.cast("double")
        return _by_power(v, F.lit(0.0), base, low, high, lambda order: start(v, order)).otherwise(F.lit(ceiling))

    def hi(lo: Column) -> Column:
        end = lambda order: lo + F.lit(step_of(order)) - 1
        return _by_power(lo, F.lit(smallest - 1), base, low, high, end).otherwise(F.lit(HIGHEST))

    return Bucketizer(lo, hi)


def event_linear(low: int, high: int, step: int) -> Bucketizer:
    """Linear buckets inside ``[low, high)`` with one bucket on either side."""
    first, last, width = float(low), float(high), float(step)

    def lo(v: Column) -> Column:
        v = v.cast("double")
        inside = F.lit(first) + F.floor((v - F.lit(first)) / F.lit(width)).cast("double") * F.lit(width)
        return F.when(v < F.lit(first), F.lit(LOWEST)).when(v >= F.lit(last), F.lit(last)).otherwise(inside)

    def hi(lo: Column) -> Column:
        return (
            F.when(lo < F.lit(first), F.lit(first - 1))
            .when(lo >= F.lit(last), F.lit(HIGHEST))
            .otherwise(lo + F.lit(width - 1))
        )

    return Bucketizer(lo, hi)


def subsecond_ms(ts_ns: Column) -> Column:
    """Whole milliseconds since the last full second."""
    return F.floor(F.pmod(ts_ns, F.lit(1_000_000_000)) / F.lit(1_000_000)).cast("bigint")


def subsecond_range(ts_ns: Column) -> Range:
    return event_linear(0, 1000, 10)(subsecond_ms(ts_ns))
