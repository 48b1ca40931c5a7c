"""Tail probabilities on the driver or per small batch; no statistics package is needed."""

from __future__ import annotations

import math


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    x = df / (df + t * t)
    return incomplete_beta(df / 2, 0.5, x)


def chi2_one(x: float) -> float:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out / a


def hypergeometric_greater(hits: int, drawn: int, events: int, total: int) -> float:
    """P(X >= hits) when `drawn` of `total` rows, `events` of them positive, are drawn: Fisher's exact test, greater."""
    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    top = min(drawn, events)
    if hits > top:
        return 0.0
    start = max(hits, drawn - (total - events), 0)
    logs, high = [], -math.inf
    for k in range(start, top + 1):
        logs.append(choose(events, k) + choose(total - events, drawn - k) - choose(total, drawn))
        high = max(high, logs[-1])
        if logs[-1] < high - 60:  # beyond the mode terms only shrink
            break
    return min(1.0, math.exp(high) * sum(math.exp(x - high) for x in logs))
