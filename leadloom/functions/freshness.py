"""Age and freshness of evidence against an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import constants as K


def age_days(last: Column, now: Column) -> Column:
    """Days from last to now as a fraction; null when never."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(now) - micros(last)) / 86_400_000_000.0


def is_fresh(last: Column, now: Column, kind: str) -> Column:
    return F.coalesce(age_days(last, now) <= K.FRESH_DAYS[kind], F.lit(False))


def freshness_score(last: Column, now: Column, kind: str) -> Column:
    """1 when new, 0.7 at the limit, 0 at twice the limit, 0.2 when never."""
    a, limit = age_days(last, now), float(K.FRESH_DAYS[kind])
    return (
        F.when(a.isNull(), 0.2).when(a <= 0, 1.0).when(a >= limit * 2, 0.0).when(a <= limit, 1 - a / limit * 0.3)
        .otherwise(F.greatest(F.lit(0.0), 0.7 - (a - limit) / limit * 0.7))
    )
