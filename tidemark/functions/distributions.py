"""Normal and Student-t tails for already-aggregated rows (F8).

Spark has no erf, so these run as Arrow pandas UDFs. They are meant for result
tables (one row per feature, fold or group), never for raw data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER_GAMMA = 0.5772156649


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), vectorised."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    left = front * _betacf(a, b, inner) / a
    right = 1.0 - front * _betacf(b, a, 1.0 - inner) / b
    out = np.where(inner < (a + 1.0) / (a + b + 2.0), left, right)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN in, NaN out."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    with np.errstate(over="ignore"):
        x = np.where(np.isinf(safe_t), 0.0, safe_df / (safe_df + safe_t**2))
    return np.where(ok, incomplete_beta(safe_df / 2.0, 0.5, x), np.nan)



@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def _phi(z: pd.Series) -> pd.Series:
    return z.astype(float).map(lambda v: float("nan") if math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value; NULL where it is undefined."""
    p = _t_tail(t.cast("double"), df.cast("double"))
    return F.when(t.isNotNull() & (df > 0) & ~F.isnan(p), p)


def norm_cdf(z: Column) -> Column:
    p = _phi(z.cast("double"))
    return F.when(z.isNotNull() & ~F.isnan(p), p)


def expected_max_z(n_trials: int) -> float:
    """Expected maximum of ``n_trials`` standard normals (Bailey & Lopez de Prado 2014)."""
    if n_trials <= 1:
        return 0.0
    ppf = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * ppf(1 - 1 / n_trials) + EULER_GAMMA * ppf(1 - 1 / (n_trials * math.e))
