"""Statistics as column expressions; undefined cases are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; null without trials. n may be an effective size.

    n is made a double first: the square of a count of 23,171 is no int.
    """
    n = n.cast("double")
    p, z2 = k / n, z * z
    den = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / den
    half = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + F.lit(z2) / (4 * n * n))) / den
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def share(n: Column, d: Column, digits: int | None = None) -> Column:
    """n / d, null when d is 0."""
    out = F.when(d != 0, n / d)
    return F.round(out, digits) if digits is not None else out


def observations_needed(rate: Column, confidence: float = 0.95) -> Column:
    """Trials without an event from which a rate is excluded at the confidence."""
    return F.ceil(-F.log(F.lit(1 - confidence)) / rate)


def nines(lower: Column) -> Column:
    """How many nines a lower bound shows."""
    return F.when(lower >= 1, F.lit(None)).when(lower <= 0, 0.0).otherwise(-F.log10(1 - lower))


def lognormal_interval(seen: Column, total: Column, var: Column) -> tuple[Column, Column]:
    """Interval of a total that never falls below what was seen: log-normal on the unseen part."""
    unseen = total - seen
    c = F.exp(Z95 * F.sqrt(F.log(1 + var / (unseen * unseen))))
    known = (unseen <= 1e-9) | (var <= 0)
    return F.when(known, seen).otherwise(seen + unseen / c), F.when(known, F.greatest(seen, total)).otherwise(seen + unseen * c)


def chapman(n1: Column, n2: Column, both: Column) -> dict[str, Column]:
    total = (n1 + 1) * (n2 + 1) / (both + 1) - 1
    var = (n1 + 1) * (n2 + 1) * (n1 - both) * (n2 - both) / ((both + 1) * (both + 1) * (both + 2))
    seen = (n1 + n2 - both).cast("double")
    low, high = lognormal_interval(seen, total, var)
    return {"observed": seen, "n_hat": total, "lo": low, "hi": F.when(both == 0, F.lit(float("inf"))).otherwise(high), "se": F.sqrt(var)}


def chao(seen: Column, f1: Column, f2: Column, t: int) -> dict[str, Column]:
    """Lower bound of a total from how many were caught once and twice by t detectors."""
    a, seen = (t - 1) / t, seen.cast("double")
    f1, f2 = f1.cast("double"), f2.cast("double")
    r = F.when(f2 > 0, f1 / f2)
    total = F.when(f2 > 0, seen + a * f1 * f1 / (2 * f2)).otherwise(seen + a * f1 * F.greatest(f1 - 1, F.lit(0.0)) / 2)
    few = a * f1 * (f1 - 1) / 2 + a * a * f1 * (2 * f1 - 1) * (2 * f1 - 1) / 4 - a * a * F.pow(f1, F.lit(4)) / 4 / F.greatest(total, F.lit(1e-9))
    var = F.when(f2 > 0, f2 * (a / 2 * r * r + a * a * F.pow(r, F.lit(3)) + a * a / 4 * F.pow(r, F.lit(4)))).otherwise(F.when(f1 > 1, F.greatest(few, F.lit(0.0))).otherwise(0.0))
    low, high = lognormal_interval(seen, total, var)
    return {"observed": seen, "n_hat": total, "lo": low, "hi": high, "se": F.sqrt(var)}


def kappa(agreed: Column, chance: Column) -> Column:
    """Agreement beyond chance; null where chance alone agrees always."""
    return F.when(chance < 1, (agreed - chance) / (1 - chance))
