"""Tails against sums that need no special function."""

import math

import pytest

from casebook.functions import tails


@pytest.mark.parametrize("x", [0.5, 3.0, 20.0, 90.0])
@pytest.mark.parametrize("half", [1, 4, 30])
def test_even_chi_square_is_a_poisson_sum(x, half):
    want = math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(half))
    assert tails.chi2_upper(x, 2 * half) == pytest.approx(want, rel=1e-11)


@pytest.mark.parametrize("t", [0.1, 1.0, 4.0])
def test_t_with_two_degrees_is_algebraic(t):
    assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-11)


def test_beta_is_a_binomial_sum():
    want = math.fsum(math.comb(9, j) * 0.3**j * 0.7 ** (9 - j) for j in range(4, 10))
    assert tails.beta_lower(4, 6, 0.3) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("df", [1e5 * (1 - 1e-9), 1e5 * (1 + 1e-9), 2e5 * (1 - 1e-9), 2e5 * (1 + 1e-9)])
def test_expansions_meet_the_fractions(df):
    """On either side of the switch a nearby distribution has nearly the same tail."""
    assert tails.t_two_sided(1.96, df) == pytest.approx(tails.t_two_sided(1.96, df * (1 + 1e-8)), rel=1e-8)
    assert tails.chi2_upper(df * 1.003, df) == pytest.approx(tails.chi2_upper(df * 1.003, df * (1 + 1e-12)), rel=1e-6)


def test_limits_at_huge_degrees_of_freedom():
    normal = 2 * tails.normal_upper(1.96)
    assert tails.t_two_sided(1.96, 1e10) == pytest.approx(normal, rel=1e-8)
    assert tails.t_two_sided(1.96, 1e12) == pytest.approx(normal, rel=1e-9)
    assert tails.chi2_upper(1e10, 1e10) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * 1e10)), abs=1e-10)
    assert tails.f_upper(3.0, 4, 1e10) == pytest.approx(tails.chi2_upper(12.0, 4), rel=1e-6)
