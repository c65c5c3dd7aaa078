"""Student's t and chi-squared distributions as column expressions.

Tail probabilities come from continued fractions and power series of a length that suffices for doubles,
evaluated from their last term; critical points from Newton steps on the logarithms of point and tail, whose
relation is concave, so that the steps can't run away. Degrees of freedom are any positive number, whole or not.

Arguments are names of columns or SQL expressions: one text is parsed, where columns built node by node would take a second.

Cases: a null or undefined argument and degrees of freedom that are not positive give null.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fraction of the t distribution needs at most 96 terms for full precision, at 10,000 degrees of freedom.
TERMS, NEWTON = 120, 15
_numbers = count()


def _once(build: Callable[..., str], *values: str) -> str:
    """``build`` of values that are computed once, however often it names them."""
    r = f"r{next(_numbers)}"
    fields = ", ".join(f"cast({v} AS double) AS v{k}" for k, v in enumerate(values))
    return f"transform(array(struct({fields})), {r} -> {build(*[f'{r}.v{k}' for k in range(len(values))])})[0]"


def _fold(terms: str, start: str, step: Callable[[str, str], str]) -> str:
    n = next(_numbers)
    return f"aggregate({terms}, cast({start} AS double), (a{n}, k{n}) -> cast({step(f'a{n}', f'k{n}')} AS double))"


def _backwards(n: str, start: str, step: Callable[[str, str], str]) -> str:
    """``step`` from the n-th term to the first one."""
    return _fold(f"sequence(cast({n} AS int), 1, -1)", start, step)


def _product(z: str, n: int, factor: Callable[[str], str]) -> str:
    return _fold(f"sequence(0, {n - 1})", "1", lambda out, k: f"{out} * {factor(f'({z} + {k})')}")


def _number(x: str) -> str:
    return f"nanvl(cast({x} AS double), NULL)"


def _positive(df: str) -> str:
    return f"nanvl(if({df} > 0, cast({df} AS double), NULL), NULL)"


def _half_step(z: str) -> str:
    """gamma(z + 1/2) / gamma(z): the asymptotic series at z + 20, and the recurrence down to z."""

    def series(y: str) -> str:
        # The coefficients of the series in 1 / y.
        terms = [1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432]
        out = "0D"
        for c in reversed(terms):
            out = f"({out} / {y} + ({c!r}D))"
        return f"sqrt({y}) * {out}"

    return f"{_product(z, 20, lambda y: f'({y} / ({y} + 0.5D))')} * {_once(series, f'{z} + 20')}"


def _log_gamma(z: str) -> str:
    """Stirling's series at z + 15, and the recurrence down to z."""

    def series(y: str) -> str:
        tail = f"(1 / 12D - (1 / 360D - (1 / 1260D - 1 / (1680D * {y} * {y})) / ({y} * {y})) / ({y} * {y})) / {y}"
        return f"({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {tail}"

    return f"({_once(series, f'{z} + 15')} - ln({_product(z, 15, lambda y: y)}))"


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta function."""

    def step(out: str, k: str) -> str:
        def term(m: str) -> str:
            odd = f"-({a} + {m}) * ({a} + {b} + {m}) / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
            even = f"{m} * ({b} - {m}) / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
            return f"if({k} % 2 = 1, {odd}, {even})"

        return f"1 + {term(f'floor({k} / 2D)')} * {x} / {out}"

    return f"1 / {_backwards(str(TERMS), '1', step)}"


def _t_tails(t: str, df: str, ratio: str) -> str:
    """Two-sided tail; ``ratio`` is :func:`_half_step` of half the degrees of freedom."""

    def parts(t: str, a: str, ratio: str, far: str, near: str) -> str:
        front = f"{ratio} / sqrt(pi()) * exp(-{a} * log1p({t} * {t} / (2 * {a}))) * sqrt({far})"
        return (
            f"CASE WHEN {a} > 0 AND abs({t}) > 1e150 THEN 0D "
            f"WHEN {near} >= ({a} + 1) / ({a} + 2.5D) THEN 1 - 2 * {front} * {_once(_beta_fraction, '0.5D', a, far)} "
            f"ELSE {front} / {a} * {_once(_beta_fraction, a, '0.5D', near)} END"
        )

    square = f"({t}) * ({t})"
    return _once(parts, t, f"{df} / 2", ratio, f"{square} / ({df} + {square})", f"{df} / ({df} + {square})")


def t_two_sided(t: str, df: str) -> Column:
    """Probability of a value at least as far from zero as ``t``."""
    return F.expr(_once(lambda t, df: _once(_t_tails, t, df, _half_step(f"({df} / 2)")), _number(t), _positive(df)))


def t_point(df: str, share: float = 0.05) -> Column:
    """Two-sided critical point of Student's t; the steps start at the normal distribution's."""

    def find(df: str, ratio: str) -> str:
        def step(t: str, p: str) -> str:
            density = f"{ratio} / sqrt(pi() * {df}) * exp(-({df} + 1) / 2 * log1p({t} * {t} / {df}))"
            return f"{t} * exp((ln({p}) - ({math.log(share)!r}D)) * {p} / (2 * {density} * {t}))"

        start = f"{NormalDist().inv_cdf(1 - share / 2)!r}D"
        return _fold(f"sequence(1, {NEWTON})", start, lambda t, _: _once(step, t, _t_tails(t, df, ratio)))

    return F.expr(_once(lambda df: _once(find, df, _half_step(f"({df} / 2)")), _positive(df)))


def _chi2_tail(x: str, df: str, log_gamma: str) -> str:
    def parts(h: str, s: str, log_gamma: str) -> str:
        n = f"(80 + ceil(10 * sqrt({s})))"
        front = f"exp({s} * ln({h}) - {h} - {log_gamma})"
        series = _backwards(n, "1", lambda out, k: f"1 + {h} / ({s} + {k}) * {out}")
        fraction = _backwards(n, f"{h} + 2 * {n} + 1 - {s}", lambda out, k: f"{h} + 2 * {k} - 1 - {s} - {k} * ({k} - {s}) / {out}")
        return (
            f"CASE WHEN {s} > 0 AND {h} <= 0 THEN 1D WHEN {s} > 0 AND {h} > 1e150 THEN 0D "
            f"WHEN {h} < {s} + 1 THEN 1 - {front} * {series} / {s} ELSE {front} / {fraction} END"
        )

    return _once(parts, f"{x} / 2", f"{df} / 2", log_gamma)


def chi2_above(x: str, df: str) -> Column:
    """Probability of a value above ``x``."""
    return F.expr(_once(lambda x, df: _once(_chi2_tail, x, df, _log_gamma(f"({df} / 2)")), _number(x), _positive(df)))


def chi2_point(df: str, share: float = 0.05) -> Column:
    """Upper critical point of the chi-squared distribution; the steps start at a bound on its tail."""
    y = f"{-math.log(share)!r}D"

    def find(df: str, log_gamma: str) -> str:
        def step(x: str, p: str) -> str:
            front = f"exp({df} / 2 * ln({x} / 2) - {x} / 2 - {log_gamma})"
            return f"{x} * exp((ln({p}) + {y}) * {p} / {front})"

        start = f"{df} + 2 * sqrt({df} * {y}) + 2 * {y}"
        return _fold(f"sequence(1, {NEWTON})", start, lambda x, _: _once(step, x, _chi2_tail(x, df, log_gamma)))

    return F.expr(_once(lambda df: _once(find, df, _log_gamma(f"({df} / 2)")), _positive(df)))
