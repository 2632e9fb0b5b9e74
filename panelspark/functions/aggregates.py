"""Aggregates as column functions, for any ``groupBy``: built from Spark's own, so they combine before the shuffle. None
gathers a group's rows; memory follows the labels named or, for the quantile, the distinct values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(value: str, q: float) -> Column:
    """The exact quantile with linear interpolation."""
    return F.percentile(value, F.lit(q))


def ecdf(value: str, at: float) -> Column:
    """The share of non-null values of at most ``at``."""
    return F.avg((F.col(value) <= at).cast("double"))


def entropy(value: str, labels: list[str]) -> Column:
    """Entropy of the labels' shares over the logarithm of their number; 0 where a group has none of them."""
    n = F.count_if(F.col(value).isin(labels))
    shares = [F.coalesce(F.try_divide(F.count_if(F.col(value) == label), n), F.lit(0.0)) for label in labels]
    raw = sum((F.when(s > 0, -s * F.ln(s)).otherwise(0.0) for s in shares), F.lit(0.0))
    return raw / F.ln(F.lit(float(max(len(labels), 2))))


def cohen_kappa(a: str, b: str, labels: list[str]) -> Column:
    """Agreement beyond chance of rows that both sides label; 1 where chance alone would agree always, null without rows."""
    both = F.col(a).isin(labels) & F.col(b).isin(labels)
    n = F.count_if(both)
    seen = F.try_divide(F.count_if(both & (F.col(a) == F.col(b))), n)
    chance = sum((F.try_divide(F.count_if(both & (F.col(a) == x)), n) * F.try_divide(F.count_if(both & (F.col(b) == x)), n) for x in labels), F.lit(0.0))
    return F.when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance))
