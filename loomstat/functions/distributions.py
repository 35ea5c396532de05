"""Distribution functions, their inverses and z-scores for 23 statistics, as Columns.

``stat2cdf(x, code, p1, p2, p3)`` gives the lower tail, ``stat2rcdf`` the upper one, ``cdf2stat`` and
``rcdf2stat`` the inverses, ``stat2zscore`` and ``stat2hzscore`` the normal and half-normal equivalents.
Closed forms are Column expressions; the others run as Arrow-batched pandas UDFs over numpy kernels.
Parameters out of range give a lower tail of 0 and an upper one of 1. Inverses that do not exist give
plus or minus 9.99e37. Nulls give nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import ship
from . import kernels as K

BIG = 9.99e37
# The codes of the statistics, from 2 on, by name.
NAMES = "CORREL TTEST FTEST ZSCORE CHISQ BETA BINOM GAMMA POISSON NORMAL FTEST_NONC CHISQ_NONC LOGISTIC LAPLACE UNIFORM TTEST_NONC WEIBULL CHI INVGAUSS EXTVAL PVAL LOGPVAL LOG10PVAL".split()
CODES = {name: k + 2 for k, name in enumerate(NAMES)}
CLOSED = {"LOGISTIC", "LAPLACE", "UNIFORM", "WEIBULL", "EXTVAL", "PVAL", "LOGPVAL", "LOG10PVAL"}


def intent_code(name: str | None) -> int:
    """Code of a statistic by its name in any case, -1 if there is none."""
    return CODES.get((name or "").upper(), -1)


def _closed(x: Column, name: str, a: float, b: float, c: float) -> tuple[Column, Column]:
    """Both tails."""
    x, one, zero = x.cast("double"), F.lit(1.0), F.lit(0.0)
    null = lambda v: F.when(x.isNotNull(), v)
    bad = null(zero), null(one)
    if name == "PVAL":
        q = F.when((x >= 0) & (x <= 1), x).otherwise(null(one))
        return one - q, q
    if name in ("LOGPVAL", "LOG10PVAL"):
        q = F.exp(-F.abs(x)) if name == "LOGPVAL" else F.pow(F.lit(10.0), -F.abs(x))
        return one - q, q
    if name == "UNIFORM":
        if b <= a:
            return bad
        y = (x - a) / (b - a)
        return F.greatest(zero, F.least(one, y)) + null(zero), one - y
    if b <= 0:
        return bad
    y = (x - a) / b
    if name == "LOGISTIC":
        p, q = one / (one + F.exp(-y)), one / (one + F.exp(y))
        return F.when(y >= 0, one - q).otherwise(p), F.when(y >= 0, q).otherwise(one - p)
    if name == "LAPLACE":
        tail = 0.5 * F.exp(-F.abs(y))
        return F.when(y >= 0, one - tail).otherwise(tail), F.when(y >= 0, tail).otherwise(one - tail)
    if name == "WEIBULL":
        if c <= 0:
            return bad
        z = F.pow(F.greatest(y, zero), F.lit(float(c)))
        return F.when(y > 0, -F.expm1(-z)).otherwise(null(zero)), F.when(y > 0, F.exp(-z)).otherwise(null(one))
    z = F.exp(-y)  # EXTVAL
    return F.when(y > -5, F.exp(-z)).otherwise(null(zero)), F.when(y > -5, -F.expm1(-z)).otherwise(null(one))


def _closed_inverse(p: Column, q: Column, name: str, a: float, b: float, c: float) -> Column:
    big, either = F.lit(BIG), p.isNotNull() & q.isNotNull()
    if name == "PVAL":
        return q
    if name in ("LOGPVAL", "LOG10PVAL"):
        return F.when(q > 0, -(F.ln(q) if name == "LOGPVAL" else F.log10(q))).otherwise(F.when(either, big))
    if (name == "UNIFORM" and b <= a) or (name != "UNIFORM" and b <= 0):
        return F.when(either, big)
    if name == "UNIFORM":
        return a + (b - a) * p
    if name == "LOGISTIC":
        z = F.when(p <= 0, -big).when(q <= 0, big).when(p < q, -F.ln(F.lit(1.0) / p - 1)).otherwise(F.ln(F.lit(1.0) / q - 1))
    elif name == "LAPLACE":
        z = F.when(p <= 0, -big).when(q <= 0, big).when(p < q, F.ln(2 * p)).otherwise(-F.ln(2 * q))
    elif name == "WEIBULL":
        z = F.when(p <= 0, 0.0).when(q <= 0, big).otherwise(F.pow(-F.ln(q), F.lit(1.0 / c))) if c > 0 else F.when(either, 0.0)
    else:
        z = F.when(p <= 0, -big).when(p >= 1, big).otherwise(-F.ln(-F.ln(p)))
    return a + b * z


def tails(x: np.ndarray, name: str, a: float = 0, b: float = 0, c: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both tails of the statistics without a closed form, over an array."""
    x = np.asarray(x, float)
    none = np.zeros(x.shape), np.ones(x.shape)

    def where(ok, pq):
        ok = np.broadcast_to(ok, x.shape)
        return np.where(ok, pq[0], 0.0), np.where(ok, pq[1], 1.0)

    with np.errstate(all="ignore"):
        if name == "ZSCORE":
            return K.normal_pq(x)
        if name == "NORMAL":
            return K.normal_pq((x - a) / b) if b > 0 else none
        if name == "CORREL":
            y = 0.5 * (x + 1)
            return where(y > 0, K.beta_pq(a / 2, a / 2, y)) if a > 0 else none
        if name == "BETA":
            return where(x > 0, K.beta_pq(a, b, x)) if a > 0 and b > 0 else none
        if name == "TTEST":
            if a <= 0:
                return none
            half = 0.5 * K.beta_pq(a / 2, 0.5, a / (a + x * x))[0]
            return np.where(x > 0, 1 - half, half), np.where(x > 0, half, 1 - half)
        if name == "FTEST":
            return where(x > 0, K.beta_pq(a / 2, b / 2, a * x / (a * x + b))) if a > 0 and b > 0 else none
        if name in ("CHISQ", "CHI"):
            return where(x > 0, K.gamma_pq(a / 2, (x * x if name == "CHI" else x) / 2)) if a > 0 else none
        if name == "GAMMA":  # b multiplies x
            return where(x > 0, K.gamma_pq(a, x * b)) if a > 0 and b > 0 else none
        if name == "POISSON":
            q, p = K.gamma_pq(np.maximum(x, 0) + 1, a)
            return where(x >= 0, (p, q)) if a >= 0 else none
        if name == "BINOM":
            if a <= 0 or b < 0:
                return none
            q, p = K.beta_pq(np.maximum(x, 0) + 1, np.maximum(a - x, 1e-300), b)
            return where(x >= 0, (np.where(x >= a, 1.0, p), np.where(x >= a, 0.0, q)))
        if name == "CHISQ_NONC":
            if a <= 0 or b < 0:
                return none
            p = K.poisson_mixture(b / 2, lambda k: K.gamma_pq(a / 2 + k, np.maximum(x, 0) / 2)[0], x)
            return where(x > 0, (p, np.clip(1 - p, 0, 1)))
        if name == "FTEST_NONC":
            if a <= 0 or b <= 0 or c < 0:
                return none
            y = np.maximum(x, 0)
            p = K.poisson_mixture(c / 2, lambda k: K.beta_pq(a / 2 + k, b / 2, a * y / (a * y + b))[0], x)
            return where(x > 0, (p, np.clip(1 - p, 0, 1)))
        if name == "TTEST_NONC":
            return _t_noncentral(x, a, b) if a > 0 else none
        if name == "INVGAUSS":
            if a <= 0 or b <= 0:
                return none
            y, shape = x / a, b / a
            ok = y > 0
            z = np.where(ok, y, 1.0)
            r = np.sqrt(shape / z)
            p1, p2 = K.normal_pq(r * (z - 1))[0], K.normal_pq(-r * (z + 1))[0]
            p = p1 + np.where(p2 > 0, np.exp(2 * shape + np.log(np.maximum(p2, 1e-320))), 0)
            return where(ok, (np.clip(p, 0, 1), np.clip(1 - p, 0, 1)))
    raise ValueError(f"no statistic {name}")


def _t_noncentral(x: np.ndarray, dof: float, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Lenth's series; for negative x by reflection."""
    flip = x < 0
    d = np.where(flip, -delta, delta)
    y = x * x / (x * x + dof)
    lam = d * d / 2
    total = np.zeros(x.shape)
    for k in range(5000):
        log_p = -lam + k * np.log(np.maximum(lam, 1e-300)) - K.log_gamma(np.array(k + 1.0))
        p = np.where((lam > 0) | (k == 0), np.exp(np.where(lam > 0, log_p, 0.0)), 0.0)
        log_q = -lam + k * np.log(np.maximum(lam, 1e-300)) - K.log_gamma(np.array(k + 1.5))
        q = np.where((lam > 0) | (k == 0), np.exp(np.where(lam > 0, log_q, -K.log_gamma(np.array(1.5)))), 0.0) * d / np.sqrt(2.0)
        add = p * K.beta_pq(k + 0.5, dof / 2, y)[0] + q * K.beta_pq(k + 1.0, dof / 2, y)[0]
        total += add
        if k > lam.max() and (np.abs(add) < 1e-16).all():
            break
    p = np.clip(K.normal_pq(-d)[0] + 0.5 * total, 0, 1)
    return np.where(flip, 1 - p, p), np.where(flip, p, 1 - p)


def inverse(p: np.ndarray, q: np.ndarray, name: str, a: float = 0, b: float = 0, c: float = 0) -> np.ndarray:
    """The statistic whose tails are p and q, for those without a closed form."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    real = name in ("ZSCORE", "NORMAL", "TTEST", "TTEST_NONC")
    needs = {"NORMAL": b, "CORREL": a, "TTEST": a, "CHISQ": a, "CHI": a, "TTEST_NONC": a, "POISSON": a, "CHISQ_NONC": a, "BINOM": a, "BETA": min(a, b), "FTEST": min(a, b), "GAMMA": min(a, b), "INVGAUSS": min(a, b), "FTEST_NONC": min(a, b)}
    if needs.get(name, 1) <= 0:
        return np.full(p.shape, BIG)
    cdf = lambda x: tails(x, name, a, b, c)
    if name == "CORREL":
        low, high = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    elif name == "BETA":
        low, high = np.zeros(p.shape), np.ones(p.shape)
    elif name == "BINOM":
        low, high = np.zeros(p.shape), np.full(p.shape, float(a))
    else:
        low, high = K.bracket(cdf, p, q, 8.0, -np.inf if real else 0.0)
    x = K.bisect(cdf, p, q, low, high)
    bottom = {"CORREL": -1.0}.get(name, -BIG if real else 0.0)
    top = {"CORREL": 1.0, "BETA": 1.0, "BINOM": float(a)}.get(name, BIG)
    return np.where(p <= 0, bottom, np.where(q <= 0, top, x))


def _udf(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out, ok = np.full(len(x), np.nan), x.notna().to_numpy()
        if ok.any():
            out[ok] = f(x[ok].to_numpy(float))
        return pd.Series(out, dtype="float64").where(ok, None)

    return run


def _name(code: int | str) -> str:
    if isinstance(code, str):
        code = intent_code(code)
    if not 2 <= code < 2 + len(NAMES):
        raise ValueError(f"no statistic {code}")
    return NAMES[code - 2]


def _tail(x: Column, code: int | str, p: tuple[float, float, float], which: int) -> Column:
    name = _name(code)
    if name in CLOSED:
        return _closed(x, name, *p)[which]
    return _udf(lambda v: tails(v, name, *p)[which])(x.cast("double"))


def stat2cdf(x: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    return _tail(x, code, (p1, p2, p3), 0)


def stat2rcdf(x: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    return _tail(x, code, (p1, p2, p3), 1)


def _stat(v: Column, code: int | str, p: tuple[float, float, float], upper: bool) -> Column:
    name = _name(code)
    v = v.cast("double")
    if name in CLOSED:
        return _closed_inverse(1 - v, v, name, *p) if upper else _closed_inverse(v, 1 - v, name, *p)
    return _udf(lambda x: inverse(1 - x, x, name, *p) if upper else inverse(x, 1 - x, name, *p))(v)


def cdf2stat(p: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    return _stat(p, code, (p1, p2, p3), False)


def rcdf2stat(q: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    return _stat(q, code, (p1, p2, p3), True)


def _z(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return inverse(p, q, "ZSCORE")


def stat2zscore(x: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    """The normal deviate with the same lower tail."""
    name = _name(code)
    if name == "ZSCORE":
        return x.cast("double")
    if name == "NORMAL":
        return (x - p1) / p2
    if name in CLOSED:
        p, q = _closed(x, name, p1, p2, p3)
        ship(SparkSession.active())

        @F.pandas_udf("double")
        def both(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(_z(a.to_numpy(float), b.to_numpy(float))).where(a.notna(), None)

        return both(p, q)
    return _udf(lambda v: _z(*tails(v, name, p1, p2, p3)))(x.cast("double"))


def stat2hzscore(x: Column, code: int | str, p1: float = 0, p2: float = 0, p3: float = 0) -> Column:
    """The half-normal deviate with the same lower tail."""
    return _udf(lambda p: _z(0.5 * (1 + p), 0.5 * (1 - p)))(stat2cdf(x, code, p1, p2, p3))


def table(spark, code: int | str, bottom: float, top: float, step: float, p: tuple[float, float, float] = (0, 0, 0)):
    """(x, p, q, density, z, hz) over a range; the density is 1000 * (cdf(x + 0.001) - cdf(x))."""
    n = int(np.floor((top - bottom) / step + 1e-9)) + 1
    x = F.lit(float(bottom)) + F.col("id") * float(step)
    return spark.range(max(n, 0)).select(x.alias("x"), stat2cdf(x, code, *p).alias("p"), stat2rcdf(x, code, *p).alias("q"), (1000 * (stat2cdf(x + 0.001, code, *p) - stat2cdf(x, code, *p))).alias("density"), stat2zscore(x, code, *p).alias("z"), stat2hzscore(x, code, *p).alias("hz"))
