"""Tails against known values."""

import math

import pytest

from cellmorph.functions import special


@pytest.mark.parametrize("t,df,p", [(2.228138852, 10, 0.05), (12.7062047362, 1, 0.05), (0.0, 5, 1.0), (2.5758293035, 1e7, 0.01)])
def test_t(t, df, p):
    assert special.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("x,df,p", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (18.30703805, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2(x, df, p):
    assert special.chi2_upper(x, df) == pytest.approx(p, abs=1e-8)


def test_digamma():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6)
    for x in (0.01, 0.5, 3.0, 50.0):
        assert special.inverse_digamma(special.digamma(x)) == pytest.approx(x, rel=1e-8)


def test_dirichlet_fit_is_a_fixed_point():
    alpha = [2.0, 5.0, 1.0, 0.5]
    means = [special.digamma(a) - special.digamma(sum(alpha)) for a in alpha]
    assert special.dirichlet_fit(means, [1.0] * 4) == pytest.approx(alpha, rel=1e-6)
