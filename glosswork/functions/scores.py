"""Score columns from counts of exact (m), conflated (c), spurious (s) and missed (n) spans; a ratio over nothing is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def strict(m: Column, c: Column, s: Column, n: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 that count exact spans alone."""
    p, r = ratio(m, m + c + s), ratio(m, m + c + n)
    return p, r, f1(p, r)


def adapted(m: Column, c: Column, s: Column, n: Column) -> tuple[Column, Column, Column]:
    """Half credit for conflated spans, a quarter of the blame for spurious ones."""
    p, r = ratio(m + 0.5 * c, m + c + 0.25 * s), ratio(m + 0.5 * c, m + c + n)
    return p, r, f1(p, r)


def exact_only(m: Column, c: Column, s: Column, n: Column) -> tuple[Column, Column, Column]:
    """As strict, with conflated spans left out."""
    p, r = ratio(m, m + s), ratio(m, m + n)
    return p, r, f1(p, r)


def overlap_ratio(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """What two spans share over what they cover together."""
    return ratio(F.greatest(F.least(e, e2) - F.greatest(s, s2), F.lit(0)), F.greatest(e, e2) - F.least(s, s2))
