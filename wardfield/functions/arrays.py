"""Expressions over feature arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(x: Column, y: Column) -> Column:
    """Euclidean distance that skips missing coordinates.

    The squared sum over the shared coordinates is scaled up by
    (all coordinates / shared ones); no shared coordinate gives NULL.
    """
    gaps = F.zip_with(x, y, lambda a, b: a - b)
    whole = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v * v))
    # Any missing coordinate makes ``whole`` NULL or NaN; only then the gaps are sifted.
    kept = F.filter(gaps, lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v * v)
    partial = F.sqrt(F.try_divide(total * F.size(gaps), F.size(kept)))
    return F.coalesce(F.nanvl(whole, F.lit(None).cast("double")), partial)
