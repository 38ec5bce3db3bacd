"""Interval bounds and distribution functions.

Closed forms are column expressions. Beta and Student quantiles have none: they are
computed by Arrow UDFs, which callers apply to distinct arguments only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = NormalDist().inv_cdf(0.975)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL, never 0, where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson score bounds of k successes in n trials, within [0, 1]; NULL for n = 0."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    spread = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / spread
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / spread
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    # greatest and least skip NULLs
    return F.when(n > 0, low), F.when(n > 0, high)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def beta_quantile(q: float, a: float, b: float) -> float:
    """The x with incomplete_beta(a, b, x) = q, by bisection to full precision."""
    low, high = 0.0, 1.0
    while high - low > 1e-16 and (mid := (low + high) / 2) not in (low, high):
        low, high = (mid, high) if incomplete_beta(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def student_quantile(q: float, df: float) -> float:
    """The q-quantile, q >= 1/2."""
    x = beta_quantile(2 * (1 - q), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x)


def clopper_pearson_bounds(k: int, n: int, alpha: float) -> tuple[float | None, float | None]:
    if n == 0:
        return None, None
    low = 0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)
    return low, 1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(_doubles("low", "high"))
def clopper_pearson(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Exact binomial bounds; apply it to distinct (k, n, alpha)."""
    rows = [clopper_pearson_bounds(int(a), int(b), float(c)) for a, b, c in zip(k, n, alpha, strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"], dtype="float64")


@F.pandas_udf(_doubles("ci_low", "ci_high", "p"))
def corrected_t(mean: pd.Series, se: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Student interval and two-sided p of mean / se with k - 1 degrees; NULL where se is 0."""
    rows = []
    for m, s, n in zip(mean, se, k, strict=True):
        if pd.isna(s) or not s > 0 or n < 3:
            rows.append((None, None, None))
        else:
            q = student_quantile(0.975, n - 1)
            rows.append((m - q * s, m + q * s, student_two_sided(m / s, n - 1)))
    return pd.DataFrame(rows, columns=["ci_low", "ci_high", "p"], dtype="float64")
