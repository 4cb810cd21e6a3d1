"""SQL for the pairwise engine: the recursions of Levinson and Whittle written out order by order, and what follows from them.

Given r (tau, i, j, r) and nt (n), the common table expressions of `engine` give s (src, dst, xi, xi_pair, p, f, lr)
and pe (src, dst, f, p_edge), with orders 0..p by the Bayesian criterion and p <= 3.
"""

from __future__ import annotations

from itertools import product

Matrix = list[list[str]]
_CELLS = list(product((0, 1), (0, 1)))


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [[f"({a[i][0]} * {b[0][j]} + {a[i][1]} * {b[1][j]})" for j in (0, 1)] for i in (0, 1)]


def _minus(a: Matrix, b: Matrix) -> Matrix:
    return [[f"({a[i][j]} - {b[i][j]})" for j in (0, 1)] for i in (0, 1)]


def _turned(a: Matrix) -> Matrix:
    return [[a[j][i] for j in (0, 1)] for i in (0, 1)]


def _det(a: Matrix) -> str:
    return f"({a[0][0]} * {a[1][1]} - {a[0][1]} * {a[1][0]})"


def _inverse(a: Matrix) -> Matrix:
    d = _det(a)
    return [[f"({a[1][1]} / {d})", f"(-{a[0][1]} / {d})"], [f"(-{a[1][0]} / {d})", f"({a[0][0]} / {d})"]]


def _named(name: str) -> Matrix:
    return [[f"{name}_{i}{j}" for j in (0, 1)] for i in (0, 1)]


def _columns(name: str, m: Matrix) -> str:
    return ", ".join(f"{m[i][j]} AS {name}_{i}{j}" for i, j in _CELLS)


def levinson(p: int) -> str:
    """uni (i, u0 .. up): error variances of one series by order."""
    out = [f"u0 AS (SELECT i, {', '.join(f'max(r) FILTER (WHERE tau = {k}) AS r{k}' for k in range(p + 1))}, max(r) FILTER (WHERE tau = 0) AS u0 FROM r WHERE i = j GROUP BY i)"]
    for m in range(1, p + 1):
        said = "".join(f" - b{m - 1}_{k} * r{m - k}" for k in range(1, m))
        out.append(f"k{m} AS (SELECT *, (r{m}{said}) / u{m - 1} AS k{m} FROM u{m - 1})")
        b = [f"b{m - 1}_{k} - k{m} * b{m - 1}_{m - k} AS b{m}_{k}" for k in range(1, m)] + [f"k{m} AS b{m}_{m}"]
        out.append(f"u{m} AS (SELECT *, {', '.join(b)}, u{m - 1} * (1 - k{m} * k{m}) AS u{m} FROM k{m})")
    return ",\n".join([*out, f"uni AS (SELECT * FROM u{p})"])


def whittle(p: int) -> str:
    """duo (dst, src, s0_00 .. sp_11): error covariances of each ordered pair by order, the target first."""
    at = [("d.i", "d.i"), ("d.i", "s.i"), ("s.i", "d.i"), ("s.i", "s.i")]
    cells = ", ".join(f"max(CASE WHEN r.tau = {k} AND r.i = {a} AND r.j = {b} THEN r.r END) AS r{k}_{i}{j}" for k in range(p + 1) for (a, b), (i, j) in zip(at, _CELLS))
    out = [f"w0 AS (SELECT d.i AS dst, s.i AS src, {cells} FROM (SELECT DISTINCT i FROM r) d JOIN (SELECT DISTINCT i FROM r) s ON d.i <> s.i JOIN r ON r.i IN (d.i, s.i) AND r.j IN (d.i, s.i) GROUP BY ALL)"]
    out.append(f"v0 AS (SELECT *, {_columns('s0', _named('r0'))}, {_columns('t0', _named('r0'))} FROM w0)")
    for m in range(1, p + 1):
        delta = _named(f"r{m}")
        for k in range(1, m):
            delta = _minus(delta, _times(_named(f"a{m - 1}_{k}"), _named(f"r{m - k}")))
        out.append(f"d{m} AS (SELECT *, {_columns(f'd{m}', delta)} FROM v{m - 1})")
        d, s, t = _named(f"d{m}"), _named(f"s{m - 1}"), _named(f"t{m - 1}")
        out.append(f"x{m} AS (SELECT *, {_columns(f'a{m}_{m}', _times(d, _inverse(t)))}, {_columns(f'c{m}_{m}', _times(_turned(d), _inverse(s)))} FROM d{m})")
        a, c = _named(f"a{m}_{m}"), _named(f"c{m}_{m}")
        cols = []
        for k in range(1, m):
            cols.append(_columns(f"a{m}_{k}", _minus(_named(f"a{m - 1}_{k}"), _times(a, _named(f"c{m - 1}_{m - k}")))))
            cols.append(_columns(f"c{m}_{k}", _minus(_named(f"c{m - 1}_{k}"), _times(c, _named(f"a{m - 1}_{m - k}")))))
        cols += [_columns(f"s{m}", _minus(s, _times(a, _turned(d)))), _columns(f"t{m}", _minus(t, _times(c, d)))]
        out.append(f"v{m} AS (SELECT *, {', '.join(cols)} FROM x{m})")
    return ",\n".join([*out, f"duo AS (SELECT * FROM v{p})"])


def _best(errors: list[str], s: int) -> str:
    """The order, from 0, of the largest criterion."""
    scores = "[" + ", ".join(f"-ln({e}) - {s} * {k} * ln(n) / n" for k, e in enumerate(errors)) + "]"
    return f"list_position({scores}, list_max({scores})) - 1"


def chi2(f: str, p: str) -> str:
    """The distribution function of chi-square with 1 to 3 degrees; that of the normal one by Simpson's rule."""
    half = 2000  # intervals; off by less than 1e-10 for any argument that is not 1 to six digits anyway
    z = f"sqrt(least({f}, 72.0) / 2)"
    total = f"list_sum(list_transform(range(0, {half + 1}), lambda k: (CASE WHEN k = 0 OR k = {half} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * k / {half}, 2))))"
    erf = f"(2 / sqrt(pi()) * {z} / {half} / 3 * {total})"
    return f"CASE WHEN {p} = 0 OR {f} <= 0 THEN 0 WHEN {p} = 2 THEN 1 - exp(-{f} / 2) WHEN {p} = 1 THEN {erf} ELSE {erf} - sqrt(2 * {f} / pi()) * exp(-{f} / 2) END"


def engine(p: int) -> str:
    dets = [_det(_named(f"s{m}")) for m in range(p + 1)]
    return f"""
{levinson(p)},
{whittle(p)},
one AS (SELECT i, [{', '.join(f'u{m}' for m in range(p + 1))}][1 + {_best([f'u{m}' for m in range(p + 1)], 1)}] AS xi FROM uni, nt),
po AS (SELECT *, {_best(dets, 4)} AS p FROM duo, nt),
xi AS (SELECT src, dst, xi, [{', '.join(f's{m}_00' for m in range(p + 1))}][p + 1] AS xi_pair, p, n FROM po JOIN one ON one.i = po.dst),
s AS (SELECT src, dst, xi, xi_pair, CAST(p AS INTEGER) AS p, CASE WHEN p = 0 THEN 0.0 ELSE n * (xi / xi_pair - 1) / p END AS f, n * ln(xi / xi_pair) AS lr FROM xi),
pe AS (SELECT src, dst, f, CAST({chi2('f', 'p')} AS DOUBLE) AS p_edge FROM s)"""


def pagerank(rounds: int, damping: float = 0.85) -> str:
    """rank (i, r), given e (src, dst, without loops and repeats) and gn (i)."""
    out = ["nn AS (SELECT count(*)::DOUBLE AS n FROM gn)", "od AS (SELECT src, count(*)::DOUBLE AS k FROM e GROUP BY src)", "k0 AS (SELECT i, 1 / n AS r FROM gn, nn)"]
    for m in range(rounds):
        got = f"(SELECT dst AS i, sum(r / k) AS got FROM e JOIN od USING (src) JOIN k{m} ON k{m}.i = src GROUP BY dst)"
        lost = f"(SELECT coalesce(sum(r), 0) AS lost FROM k{m} WHERE i NOT IN (SELECT src FROM od))"
        out.append(f"k{m + 1} AS MATERIALIZED (SELECT gn.i, {1 - damping} / n + {damping} * (coalesce(got, 0) + lost / n) AS r FROM gn LEFT JOIN {got} g ON g.i = gn.i, {lost}, nn)")
    return ",\n".join([*out, f"rank AS (SELECT * FROM k{rounds})"])
