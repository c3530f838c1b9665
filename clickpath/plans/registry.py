"""Registry of named analyses: key -> (fixture, function(Funnel) -> DataFrame).

``ORDER`` holds the presentation order of a report (its ORDER BY), applied at
the report edge by :func:`ordered`: a global sort of an already-grouped,
small result. Row-grain outputs are left unsorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[str, Callable]] = {}
ORDER: dict[str, tuple[str, ...]] = {}


def analysis(key: str, fixture: str = "A", also: tuple = (), order: tuple = ()):
    """Register ``fn`` under ``key`` on ``fixture``; ``also`` adds ``<key>_<fx>`` variants.

    ``order`` lists sort columns, a leading ``-`` meaning descending.
    """
    def deco(fn):
        keys = [key] + [f"{key}_{fx.lower()}" for fx in also]
        REGISTRY[key] = (fixture, fn)
        for fx, k in zip(also, keys[1:]):
            REGISTRY[k] = (fx, fn)
        if order:
            for k in keys:
                ORDER[k] = tuple(order)
        return fn
    return deco


def ordered(key: str, df: DataFrame) -> DataFrame:
    spec = ORDER.get(key)
    if not spec:
        return df
    return df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in spec])
