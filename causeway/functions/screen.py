"""Which pairs of many series may have an order over 0: shown for nearly all pairs at the cost of a short product each.

The lagged products of two series, cut into blocks of steps, are products of the blocks' spectra, summed over blocks; these are
matrix products in single precision. c(k) and c(-k) are e(k) + o(k) and e(k) - o(k), and c(k)^2 + c(-k)^2 = 2 (e^2 + o^2).

For series of variance 1, the m-th error of both has det E_m >= det E_0 (1 - S_m / (1 - |c(0)|)). Here S_m is at most
(a_m + b_m + B_m / x_m + A_m / y_m) / (1 - N_m / sqrt(x_m y_m)): a_m, b_m are the shares of variance that the series' own
models explain, A_m, B_m sums of squares of cross-covariances at lags 1..m either way, x_m, y_m the least eigenvalues of own
covariances at lags under m, and N_m a norm of the cross part: Frobenius's, or Schatten's of fourth power. A coarser form,
with all squares over the least eigenvalue of the whole, goes first. The criterion keeps order 0 if
det E_m >= det E_0 exp(-4 m ln T / T) for all m. Pairs for which these bounds do not show it are returned, to be fitted in full.
"""

from __future__ import annotations

import numpy as np

from .autoregression import levinson

#: What is allowed for rounding: squares of covariances are taken this much larger, besides the error of each.
MORE = 1.05


def least_eigenvalues(own: np.ndarray) -> np.ndarray:
    """Of the covariances of lags under m = 1..p, for rows of autocovariances (rows, p + 1)."""
    lag = np.abs(np.subtract.outer(np.arange(own.shape[1] - 1), np.arange(own.shape[1] - 1)))
    return np.stack([np.linalg.eigvalsh(own[:, lag[:m, :m]])[:, 0] for m in range(1, own.shape[1])], 1)


class Screen:
    """For series of t steps and variance 1, and orders to p."""

    def __init__(self, t: int, p: int):
        self.t, self.p, self.n = t, p, max(64, 6 * p)
        self.step = self.n - 2 * p
        self.blocks, f = -(-t // self.step), self.n // 2 + 1
        weight = np.where(np.isin(np.arange(f), (0, self.n // 2)), 1.0, 2.0) / self.n / t
        angle = 2 * np.pi * np.outer(np.arange(p + 1), np.arange(f)) / self.n
        self.even, self.odd = (np.cos(angle) * weight).astype("f4"), (np.sin(angle[1:]) * weight).astype("f4")
        self.phase = np.exp(2j * np.pi * np.arange(f) * p / self.n)
        self.theta = -np.expm1(-4 * np.arange(1, p + 1) * np.log(t) / t) * (1 - 1e-6)
        self.off = 4 * (2 * self.blocks + f + 8) * 6e-8  # of a covariance, in single precision
        self.floor = 2 * MORE / (MORE - 1) * (2 * self.off) ** 2
        self._room: dict[tuple[int, int], list[np.ndarray]] = {}

    def left(self, x: np.ndarray) -> np.ndarray:
        """Spectra of blocks of steps: (frequency, block and part, series)."""
        x = np.pad(x, ((0, 0), (0, self.blocks * self.step - self.t))).reshape(len(x), self.blocks, self.step)
        s = np.fft.rfft(x, self.n).transpose(2, 1, 0)
        return np.concatenate([s.real, s.imag], 1).astype("f4")

    def right(self, y: np.ndarray) -> np.ndarray:
        """Spectra of blocks and the p steps on either side: (frequency, part and series, block and part)."""
        y = np.pad(y, ((0, 0), (self.p, self.blocks * self.step - self.t + self.p)))
        s = (np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, self.n, 1)[:, :: self.step]) * self.phase).transpose(2, 0, 1)
        return np.concatenate([np.concatenate([s.real, s.imag], 2), np.concatenate([s.imag, -s.real], 2)], 1).astype("f4")

    def own(self, own: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What may() and still() take of each series (3, p, series): sums of squares of autocovariances by order, as shares of
        theta; shares of variance explained; least eigenvalues."""
        error = levinson(own)[0]
        out = np.stack([np.cumsum(own[:, 1:] ** 2, 1) / self.theta, 1 - error[:, 1:] / error[:, :1], least - 2e-6])
        out[:2] += 2e-6
        return np.ascontiguousarray(out.transpose(0, 2, 1), "f4")

    def may(self, x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (in x, in y) of pairs that the coarse bound leaves, and their covariances (2 p + 1, pairs) at lags -p..p.

        x, y: of left() and right(); own_x, own_y: of own().
        """
        i, j, p = x.shape[2], y.shape[1] // 2, self.p
        if (i, j) not in self._room:
            self._room[i, j] = [np.empty((k, *r), "f4") for k, r in ((len(x), (2 * j, i)), (p + 1, (j * i,)), (p, (j * i,)), (p, (j * i,)), (6, (j * i,)))]
        s, e, o, q, (zero, first, sums, norm, low, g) = self._room[i, j]
        np.matmul(y, x, out=s)
        np.matmul(self.even, s[:, :j].reshape(len(s), -1), out=e)
        np.matmul(self.odd, s[:, j:].reshape(len(s), -1), out=o)
        np.abs(e[0], out=zero)
        zero += np.float32(self.off)
        np.multiply(zero, zero, out=first)
        np.maximum(1 - zero, 0, out=zero)
        np.minimum(own_y[2, -1][:, None], own_x[2, -1], out=low.reshape(j, i))
        sums[:] = 0
        bad = None
        for m in range(p):  # q: sums of squares of cross-covariances up to lag m + 1
            np.multiply(e[m + 1], e[m + 1], out=q[m])
            np.multiply(o[m], o[m], out=g)
            q[m] += g
            q[m] *= np.float32(2 * MORE)
            q[m] += np.float32(self.floor)
            if m:
                q[m] += q[m - 1]
            np.multiply(q[m], np.float32(1 / self.theta[m]), out=g)
            square = g.reshape(j, i)
            square += own_x[0, m]
            square += own_y[0, m][:, None]
            if m:
                sums += first
                np.sqrt(sums, out=norm)
                np.subtract(low, norm, out=norm)
                norm *= zero
            else:
                np.multiply(zero, zero, out=norm)  # the eigenvalue of order 1 is 1 - |c(0)|
                sums += first
            now = ~(g <= norm)
            bad = now if bad is None else np.logical_or(bad, now, out=bad)
            sums += q[m]
        at = np.flatnonzero(bad)
        e, o, (b, a) = e[:, at], o[:, at], np.divmod(at, i)
        return a, b, np.concatenate([(e[1:] - o)[::-1], e[:1], e[1:] + o])

    def still(self, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the pairs that the closer bound leaves. c: covariances of may(); x, y: own() of both series of each pair."""
        p, sq = self.p, MORE * c * c + self.floor
        share, norm = 1 - np.abs(c[p]) - self.off, self._norm(c)
        ahead, back, sums, keep = np.zeros_like(share), np.zeros_like(share), np.zeros_like(share), np.zeros(len(share), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for m in range(p):
                sums += sq[p]  # of the Frobenius norm
                n = np.minimum(np.sqrt(sums), norm)
                ahead += sq[p + m + 1]
                back += sq[p - m - 1]
                sums += ahead
                sums += back
                lx, ly = x[2, m], y[2, m]
                k = 1 - n / np.sqrt(lx * ly)
                keep |= ~((lx > 0) & (ly > 0) & (k > 0) & (x[1, m] + y[1, m] + ahead / ly + back / lx <= float(self.theta[m]) * share * k))
        return np.flatnonzero(keep)

    def _norm(self, v: np.ndarray) -> np.ndarray:
        """Schatten's norm of fourth power of the cross-covariances at lags under p; it bounds those of lower orders too."""
        p, total = self.p, 0.0
        for lag in range(p):  # a diagonal of C C', each entry from the one before
            g = sum(v[p - k] * v[p + lag - k] for k in range(p))
            part = g * g
            for a in range(1, p - lag):
                g = g + v[p + a] * v[p + a + lag] - v[a] * v[a + lag]
                part += g * g
            total = total + (part if lag == 0 else 2 * part)
        return np.sqrt(np.sqrt(total)) * (1 + 1e-3) + 2 * p * self.off
