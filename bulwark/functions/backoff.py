"""Delays between attempts, as columns of the attempt's number (from 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Delay = Callable[[Column], Column]


def capped(delay: Column, most: float, jitter: float, seed: int | None) -> Column:
    delay = F.least(delay, F.lit(float(most)))
    return F.round(delay * (1 + F.lit(jitter) * (F.rand(seed) - 0.5))) if jitter else delay


def exponential(base: float = 1000, multiplier: float = 2, most: float = 30000, jitter: float = 0.0, seed: int | None = 7) -> Delay:
    return lambda n: capped(F.lit(float(base)) * F.pow(F.lit(float(multiplier)), n - 1), most, jitter, seed)


def linear(base: float = 1000, most: float = 30000, jitter: float = 0.0, seed: int | None = 7) -> Delay:
    return lambda n: capped(F.lit(float(base)) * n, most, jitter, seed)


def fixed(base: float = 1000, jitter: float = 0.0, seed: int | None = 7) -> Delay:
    return lambda n: capped(F.lit(float(base)) + n * 0, base, jitter, seed)


def none() -> Delay:
    return lambda n: n * F.lit(0.0)


def composite(first: Delay, attempts: int, then: Delay) -> Delay:
    """One delay for the first attempts, another from there on."""
    return lambda n: F.when(n <= attempts, first(n)).otherwise(then(n - attempts))


def jittered_exponential(base: float = 1000, **options) -> Delay:
    return exponential(base, **{"jitter": 0.1} | options)


PRESETS = {
    "fast": exponential(100, 1.5, 2000), "standard": exponential(1000, 2, 30000), "slow": exponential(2000, 2, 60000),
    "aggressive": linear(500, 5000), "patient": exponential(5000, 1.5, 120000),
}
