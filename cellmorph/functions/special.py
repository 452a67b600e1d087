"""Tails of the t, chi-squared and normal-theory tests, and digamma: public series, for a few values at a time."""

import math


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5) if df > 0 and t == t else float("nan")


def chi2_upper(x: float, df: float) -> float:
    """The upper tail of chi-squared, by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def inverse_digamma(y: float) -> float:
    x = math.exp(y) + 0.5 if y >= -2.22 else -1 / (y + 0.5772156649015329)
    for _ in range(6):
        x -= (digamma(x) - y) / trigamma(x)
    return x


def dirichlet_fit(mean_log: list[float], start: list[float], rounds: int = 2000, tol: float = 1e-10) -> list[float] | None:
    """Maximum-likelihood alpha from the mean logs of the parts, by Minka's fixed point; None if it diverges."""
    alpha = list(start)
    for _ in range(rounds):
        top = digamma(sum(alpha))
        new = [inverse_digamma(top + m) for m in mean_log]
        if any(not 0 < a < 1e8 for a in new):
            return None
        if max(abs(a - b) / a for a, b in zip(new, alpha, strict=True)) < tol:
            return new
        alpha = new
    return alpha
