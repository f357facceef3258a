import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from estima.functions import columns as C
from estima.functions import distributions as D
from estima.functions import polynomials as P
from estima.operators import optimise as O

close = lambda a, b, tol=1e-8: math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_distributions_at_known_points():
    assert close(D.t_ppf(0.975, 10), 2.2281388519649385)
    assert close(D.chi2_ppf(0.95, 3), 7.814727903251179)
    assert close(D.f_sf(4.0, 2, 20), 0.034571613033607777)
    assert close(D.norm_ppf(0.975), 1.959963984540054)
    assert close(D.studentized_range_ppf(0.95, 3, 20), 3.577935, 1e-5)
    assert close(D.binom_cdf(3, 10, 0.5), 0.171875)
    assert close(D.poisson_cdf(2, 1.5), math.exp(-1.5) * (1 + 1.5 + 1.125))
    assert close(D.nct_cdf(2.0, 10, 0.0), D.t_cdf(2.0, 10), 1e-6)
    assert close(D.ncf_cdf(3.0, 2, 20, 0.0), D.f_cdf(3.0, 2, 20))


@pytest.mark.parametrize("p", [0.001, 0.2, 0.5, 0.9, 0.999])
def test_quantiles_invert(p):
    assert close(D.norm_cdf(D.norm_ppf(p)), p) and close(D.t_cdf(D.t_ppf(p, 4), 4), p) and close(D.f_cdf(D.f_ppf(p, 3, 7), 3, 7), p) and close(D.chi2_cdf(D.chi2_ppf(p, 5), 5), p)


def test_expressions():
    assert C.to_sql("(A > 1) & ~(B == 'x & y')") == "(A > 1)  AND   NOT (B = 'x & y')"
    assert "power(A, 2)" in C.to_sql("np.log(G) + A ** 2") and "ln(G)" in C.to_sql("np.log(G)")
    assert C.to_sql("A in [1, 2] and not B") == "A IN (1, 2) and not B"
    for bad in ("A > 1 & B < 2", "np.linalg.inv(A)", "A.__class__"):
        with pytest.raises(ValueError):
            C.to_sql(bad)


def test_columns(spark):
    x = [-3.0, -0.5, 0.0, 1.2, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(C.norm_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [D.norm_cdf(v) for v in x], atol=2e-7)
    got = [r[0] for r in df.where("x > 0").select(C.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in x if v > 0], atol=1e-11)
    got = [r[0] for r in df.select(C.cell_of(F.col("x"), [-1.0, 0.0, 2.0])).collect()]
    assert got == [0, 1, 2, 2, 3]


def test_polynomials():
    x, y = [0.0, 1.0, 2.0, 4.0], [1.0, 3.0, 2.0, 5.0]
    c, (nodes, d) = P.lagrange(x, y), P.newton(x, y)
    for a, b in zip(x, y):
        assert close(np.polyval(c[::-1], a), b) and close(P.newton_value(nodes, d, a), b)


def test_optimisers():
    f = lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2
    assert np.allclose(O.minimise(f, np.array([-1.2, 1.0]))[0], 1, atol=1e-3)
    assert O.check_gradient(lambda v: float(v @ v), lambda v: 2 * v, np.array([1.0, -2.0])) < 1e-6
    assert close(O.golden(lambda v: (v - 0.3) ** 2, -1, 1), 0.3, 1e-6)
    x, value, _ = O.branch_and_bound([-5, -4, -3], [[2, 3, 1], [4, 1, 2]], [5, 11])
    assert value == -9 and x == [1, 1, 0]
    assert O.branch_and_bound([1.0], [[1.0]], [-1.0])[0] is None
    w = O.simplex_weights(np.eye(3), np.array([0.9, 0.1, 0.0]))
    assert close(w.sum(), 1) and w.min() >= 0
