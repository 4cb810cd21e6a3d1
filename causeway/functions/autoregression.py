"""Autoregressive estimation on numpy arrays: recursions on covariances, least squares and penalised fits."""

from __future__ import annotations

import numpy as np


def lagged(x: np.ndarray, y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (lags 1..p of each column of x, side by side) and targets."""
    x = x.reshape(len(x), -1)
    if len(x) != len(y):
        raise ValueError("x and y differ in length")
    cols = [x[p - k : len(x) - k, s] for s in range(x.shape[1]) for k in range(1, p + 1)]
    return np.stack(cols, 1) if cols else np.zeros((len(x) - p, 0)), y[p:]


def covariances(x: np.ndarray, p: int) -> np.ndarray:
    """R[tau, i, j] = sum over t of x_i(t) x_j(t - tau) / T; dividing by T throughout keeps it positive semidefinite."""
    t = len(x)
    return np.stack([x[k:].T @ x[: t - k] / t for k in range(p + 1)])


def levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Error variances of orders 0..p and the coefficients of order p, for rows of autocovariances r (m, p + 1)."""
    r = np.atleast_2d(r)
    m, p = r.shape[0], r.shape[1] - 1
    eps, b = np.zeros((m, p + 1)), np.zeros((m, p))
    eps[:, 0] = r[:, 0]
    for k in range(1, p + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            reflect = (r[:, k] - (b[:, : k - 1] * r[:, k - 1 : 0 : -1]).sum(1)) / eps[:, k - 1]
        reflect = np.where(eps[:, k - 1] > 0, reflect, 0.0)
        b[:, : k - 1] -= reflect[:, None] * b[:, : k - 1][:, ::-1].copy()
        b[:, k - 1] = reflect
        eps[:, k] = eps[:, k - 1] * (1 - reflect**2)
    return eps, b


def whittle(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward error covariances of orders 0..p and the coefficients of order p, for r (m, p + 1, s, s)."""
    m, p, s = r.shape[0], r.shape[1] - 1, r.shape[2]
    ahead, back = np.zeros((m, p + 1, s, s)), np.zeros((m, p + 1, s, s))
    err, err_back = r[:, 0].copy(), r[:, 0].copy()
    out = np.zeros((m, p + 1, s, s))
    out[:, 0] = err
    tr = lambda a: np.swapaxes(a, -1, -2)
    for k in range(1, p + 1):
        delta = r[:, k] - sum((ahead[:, i] @ r[:, k - i] for i in range(1, k)), np.zeros((m, s, s)))
        a, c = delta @ _inverse(err_back), tr(delta) @ _inverse(err)
        old, old_back = ahead.copy(), back.copy()
        for i in range(1, k):
            ahead[:, i] = old[:, i] - a @ old_back[:, k - i]
            back[:, i] = old_back[:, i] - c @ old[:, k - i]
        ahead[:, k], back[:, k] = a, c
        err, err_back = err - a @ tr(delta), err_back - c @ delta
        out[:, k] = err
    return out, ahead[:, 1:]


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses; a singular one gets the pseudo-inverse."""
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def whittle_of_two(r: np.ndarray) -> np.ndarray:
    """As the first of whittle() for s = 2, written out: matrices (2, 2, m), so that a product is a few passes over rows."""
    r = np.ascontiguousarray(np.moveaxis(r, 0, -1), float)
    p, m = r.shape[0] - 1, r.shape[-1]
    ahead, back = np.zeros((p + 1, 2, 2, m)), np.zeros((p + 1, 2, 2, m))
    times = lambda a, b: a[..., :, 0, None, :] * b[..., None, 0, :, :] + a[..., :, 1, None, :] * b[..., None, 1, :, :]
    tr = lambda a: np.swapaxes(a, 0, 1)
    err, err_back = r[0].copy(), r[0].copy()
    out = np.empty_like(r)
    out[0] = err
    for k in range(1, p + 1):
        delta = r[k] - times(ahead[1:k], r[k - 1 : 0 : -1]).sum(0)
        a, c = times(delta, _inverse_of_two(err_back)), times(tr(delta), _inverse_of_two(err))
        old = ahead[1:k].copy()
        ahead[1:k] -= times(a, back[k - 1 : 0 : -1])
        back[1:k] -= times(c, old[::-1])
        ahead[k], back[k] = a, c
        err, err_back = err - times(a, tr(delta)), err_back - times(c, delta)
        out[k] = err
    return np.moveaxis(out, -1, 0)


#: Determinants of two series count as 0 below this share of the product of their variances: what rounding leaves of copies.
FLAT = 1e-14


def _inverse_of_two(a: np.ndarray) -> np.ndarray:
    """Inverses of matrices (2, 2, m); one that is singular but for rounding gets the pseudo-inverse."""
    det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    flat = np.abs(det) <= FLAT * np.abs(a[0, 0] * a[1, 1])
    out = np.array([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]]) / np.where(flat, 1.0, det)
    if flat.any():
        out[:, :, flat] = np.moveaxis(np.linalg.pinv(np.moveaxis(a[:, :, flat], -1, 0), rcond=FLAT), 0, -1)
    return out


def bic(error: np.ndarray, p: np.ndarray, t: int, s: int) -> np.ndarray:
    """To be maximised; s parameters an order. No error left counts as undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(error > 0, -np.log(np.where(error > 0, error, 1.0)), -np.inf) - s * p * np.log(t) / t


def choose_order(error: np.ndarray, t: int, s: int) -> np.ndarray:
    """The order with the largest criterion in each row, the smallest of equals."""
    return bic(error, np.arange(error.shape[1]), t, s).argmax(1)


def univariate(r: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Error variance and order of the best autoregression, for rows of autocovariances."""
    eps, _ = levinson(r)
    p = choose_order(eps, t, 1)
    return eps[np.arange(len(eps)), p], p


def bivariate(r: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error variances of both series and order, for covariances (m, p + 1, 2, 2). Copies of one series have order 0."""
    err = whittle_of_two(r)
    own = err[..., 0, 0] * err[..., 1, 1]
    det = own - err[..., 0, 1] * err[..., 1, 0]
    p = choose_order(np.where(det <= FLAT * np.abs(own), 0.0, det), t, 4)
    best = err[np.arange(len(err)), p]
    return best[:, 0, 0], best[:, 1, 1], p


def search_order(x: np.ndarray, y: np.ndarray, most: int, compat: bool = False) -> tuple[float, int]:
    """Least-squares error of y on its and others' lags, the order raised while the criterion gains.

    compat: on the first loss give the larger order's error with the smaller order.
    """
    n, s = len(y), 1 if x.ndim == 1 or x.shape[1] == 1 else 4
    best, kept = -np.inf, (float(np.var(y)), 0)
    for p in range(1, most + 1):
        a, b = lagged(x, y, p)
        error = float(np.var(b - a @ least_squares(a, b)))
        score = -n * np.log(error) - s * p * np.log(n) if error > 0 else np.inf
        if score < best:
            return (error, p - 1) if compat else kept
        best, kept = score, (error, p)
    return kept


def gram_solve(g: np.ndarray, c: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Solve g b = c; what is not positive definite gets its least diagonal added, then the pseudo-inverse."""
    g = g + ridge * np.eye(len(g))
    for extra in (0.0, float(np.diag(g).min(initial=0.0))):
        try:
            np.linalg.cholesky(g + extra * np.eye(len(g)))
            return np.linalg.solve(g + extra * np.eye(len(g)), c)
        except np.linalg.LinAlgError:
            continue
    return np.linalg.lstsq(g, c, rcond=None)[0]


def least_squares(x: np.ndarray, y: np.ndarray, weight: float = np.inf) -> np.ndarray:
    """Ordinary least squares; a finite weight adds 1 / (weight T) to the diagonal."""
    if not x.shape[1]:
        return np.zeros(0)
    t = len(y)
    return gram_solve(x.T @ x / t, x.T @ y / t, 0.0 if np.isinf(weight) else 1 / (weight * t))


def lasso_path(g: np.ndarray, c: np.ndarray, most: int):
    """The minimisers of b'gb / 2 - c'b + penalty |b| where the path bends: (penalty, b), penalty falling to 0.

    Between bends the path is straight, so each costs one solution for the active columns. It ends when `most`
    columns are active or no column is left.
    """
    n = len(c)
    b, r, active = np.zeros(n), c.astype(float).copy(), []
    penalty = float(np.abs(c).max(initial=0.0))
    tiny, entering = 1e-12 * max(penalty, 1e-300), int(np.argmax(np.abs(c))) if n else -1
    if penalty <= 0:
        return
    yield penalty, b.copy()
    barred = np.diag(g) <= 0
    left = -1
    for _ in range(8 * n + 8):
        if entering >= 0:
            active.append(entering)
        if not active:
            return
        own = g[np.ix_(active, active)]
        sign = np.sign(r[active])
        try:
            step = np.linalg.solve(own + np.eye(len(active)) * 1e-12 * own.diagonal().mean(), sign)
        except np.linalg.LinAlgError:
            return
        rate = g[:, active] @ step
        out = ~barred
        out[active] = False
        # as far as the next column joins, an active one passes 0, or the penalty ends
        with np.errstate(divide="ignore", invalid="ignore"):
            join = np.stack([(penalty - r) / (1 - rate), (penalty + r) / (1 + rate)])
        join[:, ~out] = np.inf
        if left >= 0:  # a column that has just left stands at the bound
            join[:, left] = np.where(join[:, left] <= tiny, np.inf, join[:, left])
        join[~(join > -tiny)] = np.inf
        join = np.maximum(join, 0).min(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            drop = -b[active] / step
        drop[~(drop > tiny)] = np.inf
        j, k = int(np.argmin(join)), int(np.argmin(drop))
        far = min(join[j], drop[k], penalty)
        b[active] += far * step
        r -= far * rate
        penalty -= far
        entering, left = -1, -1
        if drop[k] <= far:
            left = active.pop(k)
            b[left] = 0.0
        elif join[j] <= far:
            entering = j
        yield max(penalty, 0.0), b.copy()
        if penalty <= tiny or len(active) >= most:
            return


def _by_criterion(g: np.ndarray, c: np.ndarray, total: float, t: int) -> np.ndarray:
    """The path's member of the best Bayesian criterion; total: mean square of what is explained."""
    best, kept = np.inf, np.zeros(len(c))
    for _, b in lasso_path(g, c, max(1, t - 1)):
        error = max(total - 2 * c @ b + b @ g @ b, 1e-12 * total, 1e-300)
        score = t * np.log(error) + np.count_nonzero(b) * np.log(t)
        if score < best - 1e-12 * abs(score):
            best, kept = score, b
    return kept


def lasso(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """LASSO on standardised columns, the penalty chosen by the Bayesian criterion along the exact path."""
    if not x.shape[1]:
        return np.zeros(0)
    t, scale = len(y), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - x.mean(0)) / scale
    return _by_criterion(z.T @ z / t, z.T @ (y - y.mean()) / t, float(np.var(y)), t) / scale


def adaptive_lasso(x: np.ndarray, y: np.ndarray, nu: float = 2.0) -> np.ndarray:
    """LASSO on columns weighted by a pilot ridge fit."""
    if not x.shape[1]:
        return np.zeros(0)
    scale = x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    weight = np.abs(least_squares(x / scale, y, 2.0)) ** nu
    keep = weight > 1e-12
    b = np.zeros(x.shape[1])
    if keep.any():
        t, z = len(y), (x / scale * weight)[:, keep]
        b[keep] = _by_criterion(z.T @ z / t, z.T @ y / t, float(np.mean(y**2)), t)
    return b * weight / scale


def group_lasso(x: np.ndarray, y: np.ndarray, p: int, holdout: float = 0.25, grid: int = 100, eps: float = 1e-6) -> np.ndarray:
    """Groups of p lags each enter or leave together; the penalty is chosen on the last part of the rows."""
    if not x.shape[1]:
        return np.zeros(0)
    cut = max(1, int(len(y) * (1 - holdout)))
    a, b, test, truth = x[:cut], y[:cut], x[cut:], y[cut:]
    g, c = a.T @ a / cut, a.T @ b / cut
    step = 1 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12)
    w, kept, best = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.inf
    for penalty in np.geomspace(1e2, 1e-2, grid):
        v, t = w.copy(), 1.0
        for _ in range(200):
            z = (v - step * (g @ v - c)).reshape(-1, p)
            size = np.sqrt((z**2).sum(1, keepdims=True))
            new = (z * np.maximum(0, 1 - step * penalty / np.where(size > 0, size, 1.0))).ravel()
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, done = new + (t - 1) / t_new * (new - w), np.abs(new - w).max() < 1e-8
            w, t = new, t_new
            if done:
                break
        error = float(np.var(truth - test @ w)) if len(truth) else np.inf
        if error < best:
            best, kept = error, w.copy()
    return np.where(np.abs(kept) <= eps, 0.0, kept)


def joint_adaptive_lasso(x: np.ndarray, p: int, nu: float = 1.25, grid: int = 40, rounds: int = 300, eps: float = 1e-3) -> np.ndarray:
    """b[k, dst, src] of all equations of a system (t, n) under one penalty, by accelerated proximal gradients.

    Weights come from a pilot ridge fit; the penalty, from a falling grid with warm starts, has the best Bayesian
    criterion of the whole system. eps: least share of the largest weight that a coefficient needs to enter.
    """
    t, n = x.shape
    z = np.concatenate([x[p - k : t - k] for k in range(1, p + 1)], 1)  # lag by lag
    y, m = x[p:], t - p
    g, c = z.T @ z / m, z.T @ y / m
    pilot = np.linalg.solve(g + np.eye(n * p) / m, c)
    weight = np.abs(pilot) ** nu
    weight = np.where(weight > eps**nu * weight.max(initial=0.0), weight, 0.0)
    step = 1 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12)
    price = 1 / np.where(weight > 0, weight, 1.0)
    total, top = (y**2).sum(0) / m, float((np.abs(c) * weight).max(initial=0.0))
    best, kept, b = np.inf, np.zeros_like(c), np.zeros_like(c)
    for penalty in top * np.geomspace(1, 1e-3, grid):
        v, s = b.copy(), 1.0
        for _ in range(rounds):
            w = v - step * (g @ v - c)
            new = np.where(weight > 0, np.sign(w) * np.maximum(np.abs(w) - step * penalty * price, 0), 0.0)
            s_new = (1 + np.sqrt(1 + 4 * s * s)) / 2
            v, done = new + (s - 1) / s_new * (new - b), np.abs(new - b).max(initial=0.0) < 1e-7
            b, s = new, s_new
            if done:
                break
        error = np.maximum(total - 2 * (c * b).sum(0) + np.einsum("ij,ik,kj->j", b, g, b), 1e-300)
        score = m * np.log(error).sum() + np.count_nonzero(b) * np.log(m)
        if score < best:
            best, kept = score, b.copy()
    return kept.reshape(p, n, n).transpose(0, 2, 1)


METHODS = {"lstsqr": least_squares, "lasso": lasso, "alasso": lambda x, y: adaptive_lasso(x, y, 1.5)}


def fit(method: str, x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    if method == "glasso":
        return group_lasso(x, y, p)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {[*METHODS, 'glasso']}")
    return METHODS[method](x, y)


def block_toeplitz(rows: list[np.ndarray]) -> np.ndarray:
    """The block matrix whose block (i, j) is rows[i - j], transposed above the diagonal."""
    n = len(rows)
    return np.block([[rows[i - j] if i >= j else rows[j - i].T for j in range(n)] for i in range(n)])
