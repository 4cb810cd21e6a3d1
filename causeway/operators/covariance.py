"""Lagged covariances of all pairs of series: by joins for few series, by tiles of Arrow arrays for many."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import autoregression as ar
from ..functions import screen
from ..sources.tables import spread
from . import panel


def autocovariance(panel: DataFrame, p: int, steps: int | None = None) -> DataFrame:
    """tau, i (target), j (lagged source), r = sum of x_i(t) x_j(t - tau) / T. Rows made: n squared times p times T."""
    t = F.lit(steps) if steps else F.col("n")
    a = panel.select("t", "i", "x")
    b = panel.select(F.col("i").alias("j"), F.col("x").alias("y"), "t").select("j", "y", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("tau"), F.col("t").alias("u")).select("j", "y", "tau", (F.col("u") + F.col("tau")).alias("t"))
    n = panel.agg(F.countDistinct("t").alias("n"))
    sums = a.join(b, "t").groupBy("tau", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return (sums if steps else sums.crossJoin(F.broadcast(n))).select("tau", "i", "j", (F.col("s") / t).alias("r"))


def gram(panel: DataFrame, p: int) -> DataFrame:
    """a, b (lags 0..p of one series) and the mean of x(t - a) x(t - b) over t >= p, per series."""
    w = Window.partitionBy("i").orderBy("t")
    d = panel.select("t", "i", F.array(*[F.lag("x", k).over(w) for k in range(p + 1)]).alias("l")).filter(F.get("l", F.lit(p)).isNotNull())
    e = d.select("i", "l", F.posexplode("l").alias("a", "xa")).select("i", "a", "xa", F.posexplode("l").alias("b", "xb"))
    return e.groupBy("i", "a", "b").agg((F.sum(F.col("xa") * F.col("xb")) / F.count("*")).alias("g"))


#: Bytes of the series of two blocks, which a task holds; series in a block.
TILE_BYTES, LEAST, MOST = 48_000_000, 16, 512


def tile_size(series: DataFrame, nodes: int) -> int:
    """Series in a block: as many as memory allows, so that each is copied to few tiles, but enough tiles for all cores."""
    steps = series.agg(F.max(F.size("xs"))).first()[0] or 1
    blocks = int((2 * series.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1  # about as many tiles as cores
    return max(1, min(MOST, TILE_BYTES // (16 * steps), max(LEAST, -(-nodes // blocks))))


def tiles(series: DataFrame, nodes: int, size: int) -> DataFrame:
    """series (k, i, xs) dealt to every tile (a, b), a >= b, of blocks of `size` series that it takes part in."""
    blocks = -(-nodes // size)
    own = F.floor(F.col("k") / size).cast("int")
    rest = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return series.withColumn("block", own).withColumn("other", rest).select("k", "i", "xs", "block", F.greatest("block", "other").alias("a"), F.least("block", "other").alias("b"))


def numbered(series: DataFrame) -> DataFrame:
    """k = 0.. in order of i. Names alone are ranked, one row a series; values never meet in one task."""
    places = series.select("i", (F.row_number().over(Window.orderBy("i")) - 1).alias("k"))
    return series.join(places, "i").select("k", "i", "xs")


#: Most tasks that tiles are dealt over.
MOST_TASKS = 20_000


def dealt(series: DataFrame, nodes: int, size: int | None) -> DataFrame:
    """The tiles, each to a task of its own as far as a hash of it allows. size: series in a block, by memory if not given."""
    size = size or tile_size(series, nodes)
    blocks = -(-nodes // size)
    return spread(tiles(numbered(series), nodes, size), "a", "b", parts=max(1, min(MOST_TASKS, blocks * (blocks + 1))))


def tiled_autocovariance(series: DataFrame, nodes: int, p: int, size: int | None = None) -> DataFrame:
    """As autocovariance(), by matrix products within tiles; a task holds the series of two blocks."""
    kind = dict(series.dtypes)["i"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        left, right = (pdf[pdf.block == x].sort_values("k") for x in (a, b))
        x, y = (np.stack(v["xs"].to_numpy()) for v in (left, right))
        t, out = x.shape[1], []
        for tau in range(p + 1):
            for u, v, m, n in ((x, y, left, right), (y, x, right, left))[: 1 if a == b else 2]:
                r = u[:, tau:] @ v[:, : t - tau].T / t
                out.append(pd.DataFrame({"tau": tau, "i": np.repeat(m.i.to_numpy(), len(n)), "j": np.tile(n.i.to_numpy(), len(m)), "r": r.ravel()}))
        return pd.concat(out)

    return dealt(series, nodes, size).groupBy("a", "b").applyInPandas(one, f"tau int, i {kind}, j {kind}, r double")


def levinson_orders(cov: DataFrame, p: int) -> DataFrame:
    """i, m and eps: the error variance of every order up to p, folded over the autocovariances in the JVM."""
    own = cov.filter("i = j").groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("tau", "r"))), lambda s: s.r).alias("r"))
    zero = "struct(array(r[0]) AS eps, cast(array() AS array<double>) AS b)"
    k = "(r[m] - aggregate(zip_with(s.b, reverse(slice(r, 2, m - 1)), (u, v) -> u * v), 0D, (u, v) -> u + v)) / element_at(s.eps, -1)"
    step = f"transform(array({k}), k -> struct(concat(s.eps, array(element_at(s.eps, -1) * (1 - k * k))) AS eps, concat(zip_with(s.b, reverse(s.b), (u, v) -> u - k * v), array(k)) AS b))[0]"
    return own.select("i", F.posexplode(F.expr(f"aggregate(sequence(1, {p}), {zero}, (s, m) -> {step}).eps")).alias("m", "eps"))


def pairwise(series: DataFrame, nodes: int, p: int, size: int | None = None) -> DataFrame:
    """src, dst, xi (error of dst alone), xi_pair (given src too), order of the pair's model: all ordered pairs.

    A tile's lagged products and all its recursions are arrays; the n squared covariances never leave the task.
    """
    kind = dict(series.dtypes)["i"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        left, right = (pdf[pdf.block == x].sort_values("k") for x in (a, b))
        x, y = (np.stack(v["xs"].to_numpy()) for v in (left, right))
        t = x.shape[1]
        auto = lambda z: np.stack([(z[:, k:] * z[:, : t - k]).sum(1) / t for k in range(p + 1)], 1)
        (rx, ry), cross, back = (auto(x), auto(y)), np.stack([x[:, k:] @ y[:, : t - k].T / t for k in range(p + 1)]), np.stack([y[:, k:] @ x[:, : t - k].T / t for k in range(p + 1)])
        m, n = np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij")
        keep = left.k.to_numpy()[m] > right.k.to_numpy()[n]
        m, n = m[keep], n[keep]
        (ex, _), (ey, _) = ar.univariate(rx, t), ar.univariate(ry, t)
        out = []
        for s in range(0, len(m), 2048):
            i, j = m[s : s + 2048], n[s : s + 2048]
            r = np.empty((len(i), p + 1, 2, 2))
            r[:, :, 0, 0], r[:, :, 1, 1], r[:, :, 0, 1], r[:, :, 1, 0] = rx[i], ry[j], cross[:, i, j].T, back[:, j, i].T
            si, sj, order = ar.bivariate(r, t)
            li, lj = left.i.to_numpy()[i], right.i.to_numpy()[j]
            out.append(pd.DataFrame({"src": np.concatenate([lj, li]), "dst": np.concatenate([li, lj]), "xi": np.concatenate([ex[i], ey[j]]), "xi_pair": np.concatenate([si, sj]), "p": np.concatenate([order, order])}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("src", "dst", "xi", "xi_pair", "p")})

    return dealt(series, nodes, size).groupBy("a", "b").applyInPandas(one, f"src {kind}, dst {kind}, xi double, xi_pair double, p int")


#: Bytes of the whole series of a group of which a task holds one; groups at least; series of which pairs are screened at once.
GROUP_BYTES, GROUPS, SIDE = 96_000_000, 12, 128


def pairwise_of_order(packed: DataFrame, nodes: int, t: int, p: int, size: int | None = None) -> DataFrame:
    """The rows of pairwise() whose order is not 0, of packed() series of t steps and variance 1.

    All pairs are tested: bounds show for nearly all that order 0 has the best criterion (functions.screen), and the recursion
    of pairwise() is run for all others. Series are few bytes as they are dealt, and in few groups, so they are copied less.
    """
    kind = dict(packed.dtypes)["i"]
    if not size:
        groups = max(GROUPS, 4 * int(packed.sparkSession.sparkContext.defaultParallelism ** 0.5), -(-nodes * t * 8 // GROUP_BYTES))
        size = max(1, -(-nodes // groups))

    def one(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = key
        pdf, test = pd.concat(list(batches)), screen.Screen(t, p)
        sides = []
        for x in (a, b):
            part = pdf[pdf.block == x].sort_values("k")
            own, least = panel.covariances_of(part["xs"].tolist(), p)
            sides.append((part["i"].to_numpy(), part["xs"].tolist(), own, test.own(own, least), ar.univariate(own, t)[0]))
        (left, packs, rx, sx, ex), (right, others, ry, sy, ey) = sides
        y = panel.unpacked(others, t, p)
        spectra = [test.right(y[n : n + SIDE]) for n in range(0, len(y), SIDE)]
        for m in range(0, len(left), SIDE):
            x = panel.unpacked(packs[m : m + SIDE], t, p)
            own, ahead, found = sx[:, :, m : m + SIDE], test.left(x), [(np.zeros(0, int), np.zeros(0, int))]
            for n in range(0, len(y) if a != b else min(len(y), m + SIDE), SIDE):
                i, j, c = test.may(ahead, spectra[n // SIDE], own, sy[:, :, n : n + SIDE])
                for s in range(0, len(i), 4096):
                    u, v = i[s : s + 4096], j[s : s + 4096]
                    keep = test.still(c[:, s : s + 4096], own[:, :, u], sy[:, :, n : n + SIDE][:, :, v])
                    found.append((u[keep] + m, v[keep] + n))
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.argsort(i[i > j] if a == b else i, kind="stable")
            i, j = (i[i > j][order], j[i > j][order]) if a == b else (i[order], j[order])
            for s in range(0, len(i), 65536):
                out = _of_order(x, y, i[s : s + 65536], j[s : s + 65536], m, rx, ry, ex, ey, left, right, t, p)
                if len(out):
                    yield out

    return dealt(packed.select("i", "xs"), nodes, size).groupBy("a", "b").applyInPandas(one, f"src {kind}, dst {kind}, xi double, xi_pair double, p int")


def _of_order(x, y, i, j, first, rx, ry, ex, ey, left, right, t, p) -> pd.DataFrame:
    """Rows of pairwise() for the pairs (i, j), in order of i, whose order is not 0. x: the series from place `first`."""
    c = np.empty((len(i), 2 * p + 1))
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(i)]):
        lags = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.pad(x[i[s] - first], p), 2 * p + 1))
        np.matmul(y[j[s:e]], lags, out=c[s:e])
    c /= t
    out = []
    for s in range(0, len(i), 2048):
        u, v = i[s : s + 2048], j[s : s + 2048]
        r = np.empty((len(u), p + 1, 2, 2))
        r[:, :, 0, 0], r[:, :, 1, 1], r[:, :, 0, 1], r[:, :, 1, 0] = rx[u], ry[v], c[s : s + 2048, p:], c[s : s + 2048, p::-1]
        si, sj, order = ar.bivariate(r, t)
        keep = order > 0
        u, v, si, sj, order = u[keep], v[keep], si[keep], sj[keep], order[keep]
        li, lj = left[u], right[v]
        out.append(pd.DataFrame({"src": np.concatenate([lj, li]), "dst": np.concatenate([li, lj]), "xi": np.concatenate([ex[u], ey[v]]), "xi_pair": np.concatenate([si, sj]), "p": np.concatenate([order, order])}))
    return pd.concat(out) if out else pd.DataFrame()


def alone(packed: DataFrame, t: int, p: int) -> DataFrame:
    """For each of packed(), what pairwise() has for it as dst in pairs of order 0, src null: xi, its variance as xi_pair, p 0."""
    kind = dict(packed.dtypes)["i"]

    def apply(batches):
        for pdf in batches:
            own, _ = panel.covariances_of(pdf["xs"].tolist(), p)
            yield pd.DataFrame({"dst": pdf["i"], "xi": ar.univariate(own, t)[0], "xi_pair": own[:, 0], "p": 0})

    each = packed.select("i", "xs").mapInPandas(apply, f"dst {kind}, xi double, xi_pair double, p int")
    return each.select(F.lit(None).cast(kind).alias("src"), "dst", "xi", "xi_pair", "p")


def copies_alone(series: DataFrame, p: int) -> DataFrame:
    """As pairwise(), for each series and a copy of it: src and dst are the series' own name, xi_pair is its variance, the order 0."""
    kind = dict(series.dtypes)["i"]

    def apply(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf[s : s + 256]
                x = np.stack(part["xs"].to_numpy())
                t = x.shape[1]
                own = np.stack([(x[:, k:] * x[:, : t - k]).sum(1) / t for k in range(p + 1)], 1)
                pair, _, order = ar.bivariate(np.broadcast_to(own[:, :, None, None], (*own.shape, 2, 2)), t)
                yield pd.DataFrame({"src": part["i"], "dst": part["i"], "xi": ar.univariate(own, t)[0], "xi_pair": pair, "p": order})

    return series.select("i", "xs").mapInPandas(apply, f"src {kind}, dst {kind}, xi double, xi_pair double, p int")


def pairwise_slow(series: DataFrame, p: int, compat: bool = False) -> DataFrame:
    """As pairwise(), by least squares and an order search; one row a pair is fitted on its own."""
    kind = dict(series.dtypes)["i"]
    a, b = series.select(F.col("i").alias("dst"), F.col("xs").alias("y")), series.select(F.col("i").alias("src"), F.col("xs").alias("x"))
    pairs = a.join(b, F.col("src") != F.col("dst"))

    def apply(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                y, x = np.asarray(r.y, float), np.asarray(r.x, float)
                xi, _ = ar.search_order(y, y, p, compat)
                pair, order = ar.search_order(np.stack([y, x], 1), y, p, compat)
                rows.append((r.src, r.dst, xi, pair, order))
            yield pd.DataFrame(rows, columns=["src", "dst", "xi", "xi_pair", "p"])

    return pairs.mapInPandas(apply, f"src {kind}, dst {kind}, xi double, xi_pair double, p int")
