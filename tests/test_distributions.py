import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import distributions as d
from loomstat.functions import kernels as K

CASES = [("CORREL", (10, 0, 0), [-0.7, 0.1, 0.6]), ("TTEST", (7, 0, 0), [-2.0, 0.3, 4.0]), ("FTEST", (3, 9, 0), [0.2, 1.5, 6.0]), ("CHISQ", (4, 0, 0), [0.5, 3.0, 12.0]), ("BETA", (2, 5, 0), [0.1, 0.4, 0.8]), ("GAMMA", (2.5, 1.5, 0), [0.3, 2.0, 5.0]), ("NORMAL", (1, 2, 0), [-3.0, 1.0, 4.0]), ("ZSCORE", (0, 0, 0), [-2.0, 0.0, 2.5]), ("FTEST_NONC", (3, 9, 2), [0.4, 2.0, 6.0]), ("CHISQ_NONC", (4, 3, 0), [1.0, 5.0, 15.0]), ("TTEST_NONC", (8, 1.2, 0), [-1.0, 1.0, 4.0]), ("CHI", (3, 0, 0), [0.5, 1.5, 3.0]), ("INVGAUSS", (2, 3, 0), [0.5, 2.0, 6.0]), ("POISSON", (4, 0, 0), [1.0, 4.0, 9.0]), ("BINOM", (12, 0.3, 0), [1.0, 4.0, 9.0])]
CLOSED = [("LOGISTIC", (1, 2, 0)), ("LAPLACE", (1, 2, 0)), ("UNIFORM", (-1, 5, 0)), ("WEIBULL", (0, 2, 1.5)), ("EXTVAL", (0.5, 2, 0)), ("PVAL", (0, 0, 0)), ("LOGPVAL", (0, 0, 0)), ("LOG10PVAL", (0, 0, 0))]


@pytest.mark.parametrize(("name", "p", "xs"), CASES)
def test_inverse_of_the_distribution(name, p, xs):
    x = np.array(xs)
    a, b = d.tails(x, name, *p)
    assert np.allclose(a + b, 1) and (np.diff(a) > 0).all()
    assert np.allclose(d.inverse(a, b, name, *p), x, rtol=1e-6, atol=1e-9)


def test_against_sums_and_integrals():
    pmf = [math.comb(12, k) * 0.3**k * 0.7 ** (12 - k) for k in range(13)]
    assert np.allclose(d.tails(np.arange(13.0), "BINOM", 12, 0.3)[0], np.cumsum(pmf))
    assert np.allclose(d.tails(np.arange(9.0), "POISSON", 4)[0], np.cumsum([math.exp(-4) * 4**k / math.factorial(k) for k in range(9)]))
    t = np.linspace(0, 3, 200_001)
    f = t**1.5 * np.exp(-1.5 * t) * 1.5**2.5 / math.gamma(2.5)
    assert abs(np.trapezoid(f, t) - d.tails(np.array([3.0]), "GAMMA", 2.5, 1.5)[0][0]) < 1e-8
    t = np.linspace(-60, 1.3, 400_001)
    f = math.gamma(4) / (math.sqrt(7 * math.pi) * math.gamma(3.5)) * (1 + t * t / 7) ** -4
    assert abs(np.trapezoid(f, t) - d.tails(np.array([1.3]), "TTEST", 7)[0][0]) < 1e-6
    assert np.allclose(d.tails(np.array([1.7]), "FTEST_NONC", 3, 9, 0)[0], d.tails(np.array([1.7]), "FTEST", 3, 9)[0])
    assert np.allclose(d.tails(np.array([-1.7, 0.4]), "TTEST_NONC", 5, 0)[0], d.tails(np.array([-1.7, 0.4]), "TTEST", 5)[0])
    rng = np.random.default_rng(0)
    sample = (rng.normal(1.2, 1, 400_000)) / np.sqrt(rng.chisquare(8, 400_000) / 8)
    assert abs((sample < 2).mean() - d.tails(np.array([2.0]), "TTEST_NONC", 8, 1.2)[0][0]) < 4e-3


def test_tails_keep_small_values():
    assert np.allclose(K.normal_pq(np.array([10.0]))[1] / 7.61985302416e-24, 1, rtol=1e-9)
    assert 0 < d.tails(np.array([300.0]), "CHISQ", 4)[1][0] < 1e-60


def test_columns(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.2, 0.9, None)], "x double")
    for name, p in CLOSED:
        r = df.select("x", d.stat2cdf(F.col("x"), name, *p).alias("p"), d.stat2rcdf(F.col("x"), name, *p).alias("q")).withColumn("back", d.cdf2stat(F.col("p"), name, *p)).withColumn("back_q", d.rcdf2stat(F.col("q"), name, *p)).collect()
        assert r[3].p is None and r[3].q is None and r[3].back is None
        assert all(abs(v.p + v.q - 1) < 1e-12 for v in r[:3])
        assert abs(r[1].back - 0.2) < 1e-9 and abs(r[1].back_q - 0.2) < 1e-9, name
    r = df.select(d.stat2zscore(F.col("x"), "TTEST", 1e9).alias("z"), d.stat2hzscore(F.abs("x"), "CHI", 1).alias("h"), d.stat2zscore(F.col("x"), "LOGISTIC", 0, 1).alias("l"), d.stat2zscore(F.col("x"), "NORMAL", 1, 2).alias("n")).collect()
    assert abs(r[1].z - 0.2) < 1e-6 and abs(r[2].h - 0.9) < 1e-9 and r[0].l < 0 < r[2].l and r[1].n == -0.4 and r[3].z is None
    plan = df.select(d.stat2cdf(F.col("x"), "WEIBULL", 0, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_bad_parameters_and_names(spark):
    assert d.intent_code("ttest") == 3 and d.intent_code("Log10PVal") == 24 and d.intent_code("x") == -1 and d.intent_code(None) == -1
    for name in d.NAMES:
        if name in d.CLOSED or name == "ZSCORE":
            continue
        p, q = d.tails(np.array([0.5]), name, -1, -1, -1)
        assert (p[0], q[0]) == (0, 1), name
        assert d.inverse(np.array([0.5]), np.array([0.5]), name, -1, -1, -1)[0] == d.BIG
    with pytest.raises(ValueError, match="no statistic"):
        d.stat2cdf(F.lit(1.0), 99)
    rows = d.table(spark, "NORMAL", 0, 1, 0.5, (0, 1, 0)).collect()
    assert len(rows) == 3 and abs(rows[0].density - 0.39894) < 1e-3 and abs(rows[2].z - 1) < 1e-12
