"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

Vectors are cut into segments; from the segments' means and deviations follows an upper bound of the inner
product (for unit vectors: a lower bound of the distance), since <q, c> <= sum over segments of
w * (mean_q * mean_c + dev_q * dev_c). A segment of one component is exact. Components are first put in order of
their energy. Levels go from coarse to fine (LEVELS); at each, a candidate whose bound lies below a score that k
candidates are known to reach is dropped, and survivors are scored exactly.

That score is had for the whole table before the search: each query's k-th best score among SEEDS candidates (a
bounded sample, at most SEED_BYTES, sent to all tasks) can only be surpassed. Queries are then held in blocks
and candidates in slices of bounded size; every block meets every slice in a group of its own, and each group
returns at most k rows a query, which are merged by rank, with a top-k in every task before the shuffle.

How much is pruned depends on the data alone: `shares` tells it by level.

Defined cases. A vector that is null, or holds a component that is null or not finite (once scaled), takes no
part. Rows count, not ids: rows that share a vec_id are candidates and queries each, and a query leaves out its
own row alone. A null vec_id is a candidate like any other, last among ties; it is no query. Shorter vectors are
filled up with zeros. Components of any size are scored exactly; a score beyond the range of long counts as the
end of that range. Ties go to the smaller vec_id; a query with fewer than k candidates returns all. An empty table, or one without queries, returns no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import map_arrow, materialize, settle

K, SCALE, EVERY = 20, 64, 20
#: Components (8 bytes each) in a block of queries or a slice of candidates; queries scored at once.
HELD, AT_ONCE = 2_000_000, 128
#: Candidates whose scores give the first bound, and the bytes that they may take.
SEEDS, SEED_BYTES = 8192, 16_000_000
#: Each level's number of segments as a share of the components. From half of them on, segments have one or two.
LEVELS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
#: Where fewer candidates than this are left, they are looked at one by one.
FEW = 0.03
LONG = np.iinfo(np.int64)


def quantised(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and v, the components as they are, of vectors that take part; `scale` is applied where they are read."""
    ok = f"forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x as double)) <= {float(np.finfo(float).max) / scale!r}D)"
    good = table.filter("embedding IS NOT NULL").filter(F.expr(f"coalesce({ok}, false)"))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> cast(x as double))").alias("v"))


def matrix(col: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Scaled components, rounded down: whole numbers, as doubles hold them exactly whatever their size."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width))
    out[np.arange(width) < n[:, None]] = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False))
    return out


def cuts(width: int, share: float) -> np.ndarray:
    """Where segments start: about share * width of them; from a half on, the first ones have one component and the rest two."""
    n = max(1, min(width, round(width * share)))
    if 2 * n <= width:
        return np.cumsum([0, *map(len, np.array_split(np.arange(width), n)[:-1])])
    alone = 2 * n - width
    return np.concatenate([np.arange(alone), np.arange(alone, width, 2)])


def statistics(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose inner product bounds that of the vectors: weighted means and deviations of their segments."""
    w = np.diff(np.append(start, v.shape[1]))
    mean = np.add.reduceat(v, start, axis=1) / w
    far = np.add.reduceat((v - np.repeat(mean, w, axis=1)) ** 2, start, axis=1)
    return np.concatenate([mean * np.sqrt(w), np.sqrt(far)[:, w > 1]], 1)


def _large(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether sums of doubles could miss a whole number."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) >= 2.0**52


def _exact(q: np.ndarray, c: np.ndarray) -> list[int]:
    """Inner products of rows, in Python's integers."""
    return [sum(int(a) * int(b) for a, b in zip(x, y) if a and b) for x, y in zip(q.tolist(), c.tolist())]


def _best_of_large(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Place of query, place of candidate and score. Scaled to at most 1, products have a known error; what may be among the k best is scored exactly."""
    power = lambda v: np.frexp(np.abs(v).max(1, initial=0))[1]
    own, up = power(q), power(c)
    x, y, most = np.ldexp(q, -own[:, None]), np.ldexp(c, -up[:, None]), int(up.max(initial=0))
    off = q.shape[1] ** 2 * 2.0**-50 + 2.0**-1000
    out = []
    for i in range(len(q)):
        near = y @ x[i]
        end = np.ldexp(1.0, min(1000, 63 - int(own[i]) - most))
        low, high = (np.clip(np.ldexp(near + e, up - most) + e * 2.0**-900, -end, end) for e in (-off, off))
        other = np.flatnonzero(c_rows != q_rows[i])
        if len(other) > k:
            other = other[high[other] >= np.partition(low[other], len(other) - k)[len(other) - k]]
        score = [min(max(s, LONG.min), LONG.max) for s in _exact(np.broadcast_to(q[i], (len(other), q.shape[1])), c[other])]
        order = sorted(range(len(other)), key=lambda j: (-score[j], c_ids[other[j]]))[:k]
        out += [(i, int(other[j]), score[j]) for j in order]
    return out


def best(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, told: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of query, place of candidate and score of the k best candidates of each query, in no order.

    floor: a score that k candidates of the query are known to reach, somewhere. c_ids: what ties go by. told gets,
    for each level, how many pairs came to it and how many it left.
    """
    if not len(q) or not len(c):
        return (np.zeros(0, np.int64),) * 3
    if _large(q, c):
        rows = _best_of_large(q_rows, q, c_rows, c_ids, c, k)
        i, j, score = zip(*rows) if rows else ((), (), ())
        return np.array(i, np.int64), np.array(j, np.int64), np.array(score, np.int64)
    order = np.argsort(c_ids, kind="stable")
    c_rows, c = c_rows[order], c[order]
    # Components of most energy come first, so that those that stand alone in a segment hold as much as they can.
    by_energy = np.argsort(-np.einsum("nd,nd->d", c, c), kind="stable")
    q, c = q[:, by_energy], np.ascontiguousarray(c[:, by_energy])
    starts = [cuts(c.shape[1], s) for s in LEVELS]
    c_stats = [np.ascontiguousarray(statistics(c, s).T) for s in starts]
    turned = np.ascontiguousarray(c.T)
    # Sums of floats: what they may be off by, and a half.
    slack = 0.5 + 1e-9 * float(np.abs(q).max()) * float(np.abs(c).max()) * c.shape[1]
    out = []
    for a in range(0, len(q), AT_ONCE):
        own, rows = q[a : a + AT_ONCE], q_rows[a : a + AT_ONCE]
        alive = rows[:, None] != c_rows[None, :]
        least = floor[a : a + AT_ONCE, None] - slack
        for s, t in zip(starts, c_stats):
            mine, came = statistics(own, s), np.count_nonzero(alive)
            if came < FEW * alive.size:
                i, j = np.nonzero(alive)
                alive[i, j] = np.einsum("nd,nd->n", mine[i], t.T[j]) >= least[i, 0]
            else:
                alive &= mine @ t >= least
            if told is not None:
                told.append((came, np.count_nonzero(alive)))
        i, j = np.nonzero(alive)
        if len(i) < FEW * alive.size:
            score = np.rint(np.einsum("nd,nd->n", own[i], c[j])).astype(np.int64)
        else:
            # Only scores from the k-th best on are sorted.
            every = np.where(alive, np.rint(own @ turned).astype(np.int64), LONG.min)
            few = min(len(c), k)
            kth = np.partition(every, len(c) - few, axis=1)[:, len(c) - few]
            i, j = np.nonzero((every >= kth[:, None]) & alive)
            score = every[i, j]
        take = np.lexsort((j, -score, i))
        i, j, score = i[take], j[take], score[take]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a + i[keep], order[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    """What ties go by: the place of each id among those there, null last."""
    return np.unique([(x is None, x or 0) for x in col.to_pylist()], axis=0, return_inverse=True)[1].ravel() if col.null_count else col.to_numpy()


def shares(q: np.ndarray, c: np.ndarray, k: int = K) -> list[float]:
    """For each level, the share of all pairs that it and those before it have left, each query's true k-th score being known."""
    every = np.rint(q @ c.T)
    floor = np.partition(every, len(c) - k, axis=1)[:, len(c) - k]
    told: list[tuple[int, int]] = []
    best(np.full(len(q), -1), q, floor, np.arange(len(c)), np.arange(len(c)), c, k, told)
    n = len(LEVELS)
    return [sum(left for _, left in told[s::n]) / (len(q) * len(c)) for s in range(n)]


def _with_floor(queries: DataFrame, candidates: DataFrame, width: int, n_c: int, k: int) -> DataFrame:
    """queries with floor, the k-th best score among a bounded sample of candidates (minus infinity if there are fewer)."""
    size = max(1, min(SEEDS, SEED_BYTES // (8 * width)))
    seeds = candidates.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < math.ceil(min(1.0, size / max(1, n_c)) * (1 << 30))).limit(size).toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((seeds["row"].to_numpy(), matrix(seeds["v"], width)))  # SEED_BYTES at most

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, c = shared.value
        for batch in batches:
            floor = np.full(len(batch), -np.inf)
            q, own = matrix(batch.column("v"), width), batch.column("row").to_numpy()
            if len(rows) > k and not _large(q, c):
                for a in range(0, len(q), AT_ONCE):
                    score = np.where(own[a : a + AT_ONCE, None] == rows[None, :], -np.inf, q[a : a + AT_ONCE] @ c.T)
                    floor[a : a + AT_ONCE] = np.rint(np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], [*batch.schema.names, "floor"])

    return map_arrow(queries.select("row", "vec_id", "v"), apply, "row long, vec_id long, v array<double>, floor double")


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score; both tables as `quantised` makes them, from one written table of it."""
    spark = queries.sparkSession
    n_q, n_c = queries.count(), candidates.count()
    width = max([1, *(t.agg(F.max(F.size("v"))).first()[0] or 1 for t in (queries, candidates))])
    most = max(1, HELD // width)
    # As many slices as there are cores, if that leaves each some hundred candidates.
    parts = max(math.ceil(n_c / most), min(spark.sparkContext.defaultParallelism, math.ceil(n_c / 512)), 1)
    blocks = max(1, math.ceil(n_q / most))
    in_block, in_slice = (F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int") for seed, n in ((1, blocks), (2, parts)))
    ready = materialize(_with_floor(queries, candidates, width, n_c, k), "queries")
    q = ready.select(in_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("s"), "row", "vec_id", "v", "floor")
    c = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), in_slice.alias("s"), "row", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        settle(__name__)
        i, j, score = best(left["row"].to_numpy(), matrix(left["v"], width), left["floor"].to_numpy(), right["row"].to_numpy(), _ids(right["vec_id"]), matrix(right["v"], width), k)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table([left["row"].take(i), left["vec_id"].take(i), right["vec_id"].take(j), pa.array(score, pa.int64())], names=["row", "query_id", "vec_id", "score"])

    found = q.groupBy("b", "s").cogroup(c.groupBy("b", "s")).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.rid <> c.rid
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= {K}
"""


def query(spark, sf_dir: str) -> DataFrame:
    v = materialize(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "vectors")
    return search(v.filter(F.col("vec_id") % EVERY == 0), v)
