"""Distribution functions on numpy arrays: chi-square, F and Student t, by series and continued fractions."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300


def gamma_p(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    safe = np.clip(x, _TINY, 1e12)
    lead = np.exp(-safe + a * np.log(safe) - _LGAMMA(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        term = total = 1 / a[low]
        for n in range(1, 2000):
            term = term * safe[low] / (a[low] + n)
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[low] = total * lead[low]
    high = x >= a + 1
    if high.any():
        b = safe[high] + 1 - a[high]
        c, d = np.full(b.shape, 1 / _TINY), 1 / b
        h = d
        for n in range(1, 2000):
            k = -n * (n - a[high])
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + k / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - lead[high] * h
    return np.where(np.isnan(x), np.nan, np.clip(out, 0, 1))


def beta_i(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    y = np.clip(x, 1e-300, 1 - 1e-16)
    swap = y > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + p * np.log(z) + q * np.log1p(-z))
    c, d = np.ones(z.shape), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d
    for m in range(1, 500):
        k = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 + k * d
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1 + k / c
        h = h * d * c
        k = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + k * d
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1 + k / c
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    v = front * h / p
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 0, np.where(x >= 1, 1, np.where(swap, 1 - v, v))))


def chi2_cdf(x, df):
    return gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def f_cdf(x, d1, d2):
    x = np.maximum(np.asarray(x, float), 0)
    return beta_i(np.asarray(d1, float) / 2, np.asarray(d2, float) / 2, d1 * x / (d1 * x + d2))


def t_cdf(x, df):
    x = np.asarray(x, float)
    tail = 0.5 * beta_i(np.asarray(df, float) / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def edge_probability(f, p, t=None, f_mode=False):
    """How sure an edge is: the distribution function of its score; p = 0, negative or undefined scores give 0."""
    f, p = np.asarray(f, float), np.asarray(p, float)
    if f_mode and t is None:
        raise ValueError("the F distribution needs the number of observations")
    d = np.maximum(p, 1)
    out = f_cdf(f, d, np.maximum(t - p, 1)) if f_mode else chi2_cdf(f, d)
    return np.where((p > 0) & (f > 0), np.nan_to_num(out), 0.0)
