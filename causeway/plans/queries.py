"""Named queries over the test tables, each with SQL for an independent engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scg
from ..operators import covariance, diagnostics, granger, graph, metrics, panel, refit, simulate
from ..sources.tables import materialize
from . import classify, engine_sql, experiments, pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_values(spark, sf_dir, node: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), node, F.round(F.col("value") * 100).cast("long").alias("x"))


def events_panel(spark, sf_dir, node: str = "event_type") -> DataFrame:
    return panel.densify(events_values(spark, sf_dir, node), 3600, "t", node, "x")


def items_values(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.unix_date(F.col("l_shipdate").cast("date")).alias("t"), "l_suppkey", F.col("l_quantity").cast("long").alias("x"))


def items_panel(spark, sf_dir) -> DataFrame:
    return panel.densify(items_values(spark, sf_dir), 1, "t", "l_suppkey", "x")


E_SQL = """
ev AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS k, event_type AS i, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS x FROM events GROUP BY ALL),
b AS (SELECT min(k) AS lo, max(k) AS hi FROM ev),
g AS (SELECT i, lo, unnest(generate_series(lo, hi)) AS k FROM (SELECT DISTINCT i FROM ev), b),
panel AS (SELECT g.k - lo AS t, g.i, coalesce(x, 0)::BIGINT AS x FROM g LEFT JOIN ev ON g.k = ev.k AND g.i = ev.i)"""
L_SQL = """
ev AS (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS k, l_suppkey AS i, sum(CAST(l_quantity AS BIGINT))::BIGINT AS x FROM lineitem GROUP BY ALL),
b AS (SELECT min(k) AS lo, max(k) AS hi FROM ev),
g AS (SELECT i, lo, unnest(generate_series(lo, hi)) AS k FROM (SELECT DISTINCT i FROM ev), b),
panel AS (SELECT g.k - lo AS t, g.i, coalesce(x, 0)::BIGINT AS x FROM g LEFT JOIN ev ON g.k = ev.k AND g.i = ev.i)"""
Z_SQL = E_SQL + """,
mo AS (SELECT i, count(x)::DOUBLE AS n, sum(x)::DOUBLE AS s1, sum(x * x)::DOUBLE AS s2 FROM panel GROUP BY i),
z AS (SELECT t, p.i, (x - s1 / n) / sqrt((n * s2 - s1 * s1) / (n * n)) AS x FROM panel p JOIN mo USING (i) WHERE n * s2 - s1 * s1 > 0)"""
N_SQL = E_SQL + ", gaps AS (SELECT t, i, CASE WHEN x % 3 <> 0 THEN x::DOUBLE END AS x FROM panel)"


#: A forest of seven nodes and the lag of each edge. Its nodes take noise of their own and their parent's value.
PLANTED = {(0, 1): 1, (0, 2): 2, (1, 3): 1, (4, 5): 1, (2, 6): 1}


def _terms() -> list[tuple[int, int, int]]:
    """Node whose noise it is, node that it reaches, and after how many steps."""
    out, parent = [], {d: (s, lag) for (s, d), lag in PLANTED.items()}
    for i in range(7):
        at, lag = i, 0
        out.append((at, i, lag))
        while at in parent:
            at, lag = parent[at][0], lag + parent[at][1]
            out.append((at, i, lag))
    return out


def planted_panel(spark, sf_dir) -> DataFrame:
    """A system of known graph, driven by the daily quantities of seven classes of parts."""
    e = read(spark, sf_dir, "lineitem").select(F.unix_date(F.col("l_shipdate").cast("date")).alias("t"), (F.col("l_partkey") % 7).alias("k"), F.col("l_quantity").cast("long").alias("x"))
    noise = panel.densify(e, 1, "t", "k", "x")
    last = noise.agg(F.max("t").alias("last"))
    terms = spark.createDataFrame(_terms(), "a long, node long, lag long")
    moved = noise.join(F.broadcast(terms), F.col("i") == F.col("a")).crossJoin(F.broadcast(last)).filter("t + lag <= last")  # one row
    return moved.groupBy((F.col("t") + F.col("lag")).alias("t"), F.col("node").alias("i")).agg(F.sum("x").alias("x"))


PLANTED_SQL = f"""
ev AS (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS k, l_partkey % 7 AS i, sum(CAST(l_quantity AS BIGINT))::BIGINT AS x FROM lineitem GROUP BY ALL),
b AS (SELECT min(k) AS lo, max(k) AS hi FROM ev),
g AS (SELECT i, lo, unnest(generate_series(lo, hi)) AS k FROM (SELECT DISTINCT i FROM ev), b),
noise AS (SELECT g.k - lo AS t, g.i, coalesce(x, 0)::BIGINT AS x FROM g LEFT JOIN ev ON g.k = ev.k AND g.i = ev.i),
term(a, node, lag) AS (VALUES {', '.join(map(str, _terms()))}),
panel AS (SELECT t + lag AS t, CAST(node AS BIGINT) AS i, sum(x)::BIGINT AS x FROM noise JOIN term ON noise.i = a WHERE t + lag <= (SELECT max(t) FROM noise) GROUP BY ALL),
mo AS (SELECT i, count(x)::DOUBLE AS n, sum(x)::DOUBLE AS s1, sum(x * x)::DOUBLE AS s2 FROM panel GROUP BY i),
z AS (SELECT t, p.i, (x - s1 / n) / sqrt((n * s2 - s1 * s1) / (n * n)) AS x FROM panel p JOIN mo USING (i) WHERE n * s2 - s1 * s1 > 0)"""
PLANTED_EDGES = f"SELECT * FROM (VALUES {', '.join(f'({s}::BIGINT, {d}::BIGINT)' for s, d in PLANTED)}) AS e(src, dst)"


def z_panel(spark, sf_dir) -> DataFrame:
    return panel.zscore(events_panel(spark, sf_dir))


def gaps(spark, sf_dir) -> DataFrame:
    return events_panel(spark, sf_dir).select("t", "i", F.when(F.col("x") % 3 != 0, F.col("x").cast("double")).alias("x"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"WITH {E_SQL} SELECT t, i, x FROM panel")
def panel_events_hourly(spark, sf_dir):
    return events_panel(spark, sf_dir)


@query(f"WITH {PLANTED_SQL} SELECT t, i, x FROM panel")
def panel_planted(spark, sf_dir):
    return planted_panel(spark, sf_dir)


@query(f"WITH {L_SQL} SELECT t, i, x FROM panel")
def panel_lineitem_daily(spark, sf_dir):
    return items_panel(spark, sf_dir)


@query(f"WITH {E_SQL} SELECT t, i, round(x - sum(x) OVER (PARTITION BY i)::DOUBLE / count(x) OVER (PARTITION BY i), 6) AS x FROM panel")
def panel_demean(spark, sf_dir):
    return rounded(panel.demean(events_panel(spark, sf_dir)), "x")


@query(f"WITH {Z_SQL} SELECT t, i, round(x, 6) AS x FROM z")
def panel_zscore(spark, sf_dir):
    return rounded(z_panel(spark, sf_dir), "x")


@query(f"WITH {E_SQL} SELECT * FROM (SELECT t, i, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM panel WINDOW w AS (PARTITION BY i ORDER BY t)) WHERE l3 IS NOT NULL")
def lag_matrix(spark, sf_dir):
    d = panel.lag_matrix(events_panel(spark, sf_dir), 3)
    return d.select("t", "i", "x", *[F.get("lags", F.lit(k)).alias(f"l{k + 1}") for k in range(3)])


@query(f"WITH {E_SQL} SELECT t, i, CAST(x - lag(x) OVER (PARTITION BY i ORDER BY t) AS DOUBLE) AS x FROM panel")
def first_diff(spark, sf_dir):
    return panel.first_difference(events_panel(spark, sf_dir)).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {E_SQL}, l AS (SELECT t, i, CASE WHEN x > 0 THEN ln(x) END AS y FROM panel) SELECT t, i, round(y - lag(y) OVER (PARTITION BY i ORDER BY t), 6) AS x FROM l")
def log_return(spark, sf_dir):
    return rounded(panel.log_return(events_panel(spark, sf_dir)), "x")


@query(f"""WITH {Z_SQL}, k AS (SELECT unnest(range(24)) AS k)
SELECT a.t, a.i, round(sum(b.x * pow(pow(0.5, 1 / 2.5), k)) / sum(pow(pow(0.5, 1 / 2.5), k)), 6) AS x FROM z a CROSS JOIN k JOIN z b ON b.i = a.i AND b.t = a.t - k GROUP BY a.t, a.i""")
def ewm_halflife(spark, sf_dir):
    return rounded(panel.ewm_mean(z_panel(spark, sf_dir), 2.5, 24), "x")


@query()
def ewm_halflife_whole(spark, sf_dir):
    """Over the operator's own reach of 128 half-lives; ewm_halflife and its SQL end at 24 steps."""
    return rounded(panel.ewm_mean(z_panel(spark, sf_dir), 2.5), "x")


@query(f"""WITH {N_SQL} SELECT t, i, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(x IGNORE NULLS) OVER (PARTITION BY i ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM gaps""")
def ffill_bfill(spark, sf_dir):
    return panel.fill_both(gaps(spark, sf_dir))


@query(f"""WITH {N_SQL}, s AS (SELECT t, i, x, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS ta, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb,
 last_value(x IGNORE NULLS) OVER a AS xa, first_value(x IGNORE NULLS) OVER f AS xb FROM gaps
 WINDOW a AS (PARTITION BY i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY i ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT t, i, round(coalesce(x, xa + (xb - xa) * (t - ta) / (tb - ta), xa, xb), 6) AS x FROM s""")
def interp_linear(spark, sf_dir):
    return rounded(panel.interpolate(gaps(spark, sf_dir)), "x")


@query("""WITH b AS (SELECT min(l_shipdate) + INTERVAL 20 DAY AS lo, max(l_shipdate) - INTERVAL 20 DAY AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem, b GROUP BY l_suppkey, lo, hi HAVING min(l_shipdate) <= lo AND max(l_shipdate) >= hi)""")
def coverage_filter(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    lo, hi = d.agg(F.min("l_shipdate") + F.expr("INTERVAL 20 DAY"), F.max("l_shipdate") - F.expr("INTERVAL 20 DAY")).first()
    return panel.coverage_filter(d, "l_suppkey", "l_shipdate", F.lit(lo), F.lit(hi)).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) >= 25.5)")
def volume_filter(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return panel.volume_filter(d, "l_suppkey", "l_quantity", 25.5).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def date_clamp(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return panel.between(d, "d", F.lit("1994-01-01").cast("date"), F.lit("1995-12-31").cast("date")).withColumn("d", F.col("d").cast("string"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5")
def calendar_semi_join(spark, sf_dir):
    from ..sources import readers

    d = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return panel.on_calendar(d, readers.trading_days(spark, "1990-01-01", "2010-12-31"), "date").select("o_orderkey", F.col("date").cast("string").alias("date"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
c AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS items FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT CAST(coalesce(a.d, c.d) AS VARCHAR) AS d, orders::DOUBLE AS orders, items::DOUBLE AS items FROM a FULL JOIN c ON a.d = c.d""")
def outer_merge_panels(spark, sf_dir):
    a = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").cast("double").alias("orders"))
    c = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.count("*").cast("double").alias("items"))
    return panel.merge_outer(a, c, ["d"]).withColumn("d", F.col("d").cast("string"))


@query("""WITH m AS (SELECT event_id, (((date_part('hour', ts) * 60 + date_part('minute', ts) - 570) % 1440 + 1440) % 1440)::INTEGER AS minute, (isodow(ts) - 1)::INTEGER AS weekday FROM events)
SELECT event_id, minute, weekday FROM m WHERE minute > 100 AND minute < 291""")
def minute_of_day_trim(spark, sf_dir):
    return panel.session_trim(read(spark, sf_dir, "events"), "ts").select("event_id", "minute", "weekday")


@query(f"""WITH {N_SQL}, c AS (SELECT *, count(x) OVER (PARTITION BY i) AS n FROM gaps), f AS (SELECT t, i, last_value(x IGNORE NULLS) OVER (PARTITION BY i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x,
 dense_rank() OVER (PARTITION BY i ORDER BY t) AS k FROM c WHERE n > 0), r AS (SELECT * FROM f WHERE k > 50) SELECT t, i, round(coalesce(x, avg(x) OVER (PARTITION BY i)), 6) AS x FROM r""")
def repair_data(spark, sf_dir):
    return rounded(panel.repair(gaps(spark, sf_dir), "i", "t", ["x"]), "x").select("t", "i", "x")


@query(f"WITH {N_SQL} SELECT 'x' AS \"column\", round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM gaps")
def missing_share(spark, sf_dir):
    return rounded(panel.missing_share(gaps(spark, sf_dir), ["x"]), "share")


@query(f"WITH {N_SQL}, c AS (SELECT *, count(x) OVER (PARTITION BY t) AS n FROM gaps) SELECT t, i, x FROM c WHERE n = (SELECT count(DISTINCT i) FROM gaps) AND x IS NOT NULL")
def complete_cases(spark, sf_dir):
    d = gaps(spark, sf_dir).persist()
    return panel.complete_cases(d, d.select("i").distinct().count())


@query(f"""WITH {E_SQL}, d AS (SELECT *, t // 24 AS day FROM panel), n AS (SELECT max(day) + 1 AS days FROM d)
SELECT window_id, i, sum(x)::BIGINT AS x FROM (SELECT i, x, unnest(generate_series(greatest(0, day - 6), least(day, days - 7))) AS window_id FROM d, n) GROUP BY ALL""")
def rolling_windows(spark, sf_dir):
    d = events_panel(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 24)).persist()
    days = d.agg(F.max("day")).first()[0] + 1
    return panel.rolling_windows(d, "day", days, 7).groupBy("window_id", "i").agg(F.sum("x").alias("x"))


MOMENTS_SQL = """,
nt AS (SELECT count(DISTINCT t) AS n FROM z),
r AS (SELECT k AS tau, a.i, b.i AS j, sum(a.x * b.x) / max(n) AS r FROM z a CROSS JOIN (SELECT unnest(range(4))::INTEGER AS k) JOIN z b ON b.t = a.t - k CROSS JOIN nt GROUP BY ALL)"""
R_SQL = Z_SQL + MOMENTS_SQL


@query(f"WITH {R_SQL} SELECT tau, i, j, round(r, 6) AS r FROM r")
def autocov_r(spark, sf_dir):
    return rounded(covariance.autocovariance(z_panel(spark, sf_dir), 3), "r")


@query(f"WITH {R_SQL} SELECT tau, i, j, round(r, 6) AS r FROM r")
def autocov_tiled(spark, sf_dir):
    s = panel.to_series(z_panel(spark, sf_dir)).persist()
    return rounded(covariance.tiled_autocovariance(s, s.count(), 3, 2), "r")


@query(f"""WITH {Z_SQL}, l AS (SELECT i, [x, lag(x, 1) OVER w, lag(x, 2) OVER w] AS l, lag(x, 2) OVER w AS e FROM z WINDOW w AS (PARTITION BY i ORDER BY t)),
k AS (SELECT unnest(range(3))::INTEGER AS a), q AS (SELECT k.a, m.a AS b FROM k CROSS JOIN k m)
SELECT i, a, b, round(avg(l[a + 1] * l[b + 1]), 6) AS g FROM l CROSS JOIN q WHERE e IS NOT NULL GROUP BY ALL""")
def gram_xtx(spark, sf_dir):
    return rounded(covariance.gram(z_panel(spark, sf_dir), 2), "g")


V_SQL = R_SQL + """,
a AS (SELECT i, max(r) FILTER (WHERE tau = 0) AS r0, max(r) FILTER (WHERE tau = 1) AS r1, max(r) FILTER (WHERE tau = 2) AS r2, max(r) FILTER (WHERE tau = 3) AS r3 FROM r WHERE i = j GROUP BY i),
e1 AS (SELECT *, r0 AS e0, r1 / r0 AS k1, r0 * (1 - (r1 / r0) * (r1 / r0)) AS e1 FROM a),
e2 AS (SELECT *, (r2 - k1 * r1) / e1 AS k2, e1 * (1 - ((r2 - k1 * r1) / e1) * ((r2 - k1 * r1) / e1)) AS e2 FROM e1),
e3 AS (SELECT *, e2 * (1 - pow((r3 - (k1 - k2 * k1) * r2 - k2 * r1) / e2, 2)) AS e3 FROM e2),
eps AS (SELECT i, unnest([0, 1, 2, 3])::INTEGER AS m, unnest([e0, e1, e2, e3]) AS eps FROM e3)"""


@query(f"WITH {V_SQL} SELECT i, m, round(eps, 6) AS eps FROM eps")
def levinson_orders(spark, sf_dir):
    return rounded(covariance.levinson_orders(covariance.autocovariance(z_panel(spark, sf_dir), 3), 3), "eps")


@query(f"WITH {V_SQL} SELECT i, round(e1, 6) AS eps FROM e1")
def ar1_error(spark, sf_dir):
    return rounded(covariance.levinson_orders(covariance.autocovariance(z_panel(spark, sf_dir), 1), 1).filter("m = 1").select("i", "eps"), "eps")


@query(f"WITH {V_SQL}, c AS (SELECT i, m, -ln(eps) - m * ln(n) / n AS bic FROM eps, nt) SELECT i, arg_max(m, bic) AS p, round(max(bic), 6) AS bic FROM c GROUP BY i")
def bic_order(spark, sf_dir):
    z = z_panel(spark, sf_dir).persist()
    n = z.select("t").distinct().count()
    e = covariance.levinson_orders(covariance.autocovariance(z, 3, n), 3).withColumn("bic", granger.bic(F.col("eps"), F.col("m"), F.lit(n), 1))
    return rounded(e.groupBy("i").agg(F.min_by("m", F.struct(-F.col("bic"), "m")).alias("p"), F.max("bic").alias("bic")), "bic")


ORDERS = 3


def engine_tests(spark, sf_dir) -> DataFrame:
    """src, dst, xi, xi_pair, p, f, p_edge and lr of every ordered pair of the planted system, by the engine; written once."""
    s, n, t = _planted(spark, sf_dir)
    scored = granger.score_pairs(covariance.pairwise(s, n, ORDERS), t)
    return materialize(scored.withColumn("lr", granger.lr_score(F.col("xi"), F.col("xi_pair"), F.lit(t))), "tests")


T_SQL = PLANTED_SQL + MOMENTS_SQL + "," + engine_sql.engine(ORDERS)


@query(f"WITH {T_SQL} SELECT src, dst, round(xi, 6) AS xi, round(xi_pair, 6) AS xi_pair, p FROM s")
def pairwise_errors(spark, sf_dir):
    """Orders by criterion, and error variances of each series alone and of each pair, by recursion."""
    return rounded(engine_tests(spark, sf_dir).select("src", "dst", "xi", "xi_pair", "p"), "xi", "xi_pair")


@query(f"WITH {T_SQL} SELECT src, dst, round(f, 5) AS f FROM s")
def gc_score(spark, sf_dir):
    return rounded(engine_tests(spark, sf_dir).select("src", "dst", "f"), "f", digits=5)


@query(f"WITH {T_SQL} SELECT src, dst, round(lr, 5) AS lr FROM s")
def lr_score(spark, sf_dir):
    return rounded(engine_tests(spark, sf_dir).select("src", "dst", "lr"), "lr", digits=5)


@query(f"WITH {T_SQL} SELECT src, dst, round(p_edge, 6) AS p_edge FROM pe")
def chi2_edge_prob(spark, sf_dir):
    return rounded(engine_tests(spark, sf_dir).select("src", "dst", "p_edge"), "p_edge")


ALPHA = 0.2
B_SQL = T_SQL + f""",
o AS (SELECT 1 - p_edge AS p_value, row_number() OVER (ORDER BY 1 - p_edge, src, dst) AS rn, count(*) OVER () AS m FROM pe),
side AS (SELECT *, p_value < {ALPHA} * rn / m AS below, lead(p_value < {ALPHA} * rn / m * 1.0) OVER (ORDER BY rn) AS unused, lead(p_value) OVER (ORDER BY rn) < {ALPHA} * (rn + 1) / m AS after FROM o),
cut AS (SELECT coalesce(min_by(p_value, rn) FILTER (WHERE below <> after), min(p_value)) AS threshold FROM side)"""


def _cut(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = engine_tests(spark, sf_dir)
    return t, granger.bh_threshold(t.select((1 - F.col("p_edge")).alias("p_value"), "src", "dst"), ALPHA, ["p_value", "src", "dst"])


@query(f"WITH {B_SQL} SELECT round(threshold, 6) AS threshold FROM cut")
def bh_threshold_compat(spark, sf_dir):
    return rounded(_cut(spark, sf_dir)[1], "threshold")


@query(f"WITH {B_SQL} SELECT round(coalesce(max(p_value) FILTER (WHERE p_value <= {ALPHA} * rn / m), 0.0), 6) AS threshold FROM o")
def bh_threshold_standard(spark, sf_dir):
    t = engine_tests(spark, sf_dir).select((1 - F.col("p_edge")).alias("p_value"), "src", "dst")
    return rounded(granger.bh_threshold(t, ALPHA, ["p_value", "src", "dst"], compat=False), "threshold")


@query(f"""WITH {T_SQL}, o AS (SELECT 1 - p_edge AS p_value, row_number() OVER (ORDER BY 1 - p_edge, src, dst) AS rn, count(*) OVER () AS m FROM pe),
h AS (SELECT sum(1.0::DOUBLE / k) AS h FROM (SELECT unnest(range(1, (SELECT max(m) FROM o) + 1)) AS k)),
hs AS (SELECT rn, p_value, p_value < {ALPHA} * rn / (h * m) AS below, lead(p_value) OVER (ORDER BY rn) < {ALPHA} * (rn + 1) / (h * m) AS after FROM o, h)
SELECT round(coalesce(min_by(p_value, rn) FILTER (WHERE below <> after), min(p_value)), 6) AS threshold FROM hs""")
def bh_threshold_dependent(spark, sf_dir):
    t = engine_tests(spark, sf_dir).select((1 - F.col("p_edge")).alias("p_value"), "src", "dst")
    return rounded(granger.bh_threshold(t, ALPHA, ["p_value", "src", "dst"], independent=False), "threshold")


@query(f"WITH {B_SQL} SELECT src, dst FROM pe, cut WHERE p_edge >= 1 - threshold AND p_edge > 0")
def threshold_edges(spark, sf_dir):
    return granger.threshold_edges(*_cut(spark, sf_dir))


W_SQL = T_SQL + ", want AS (SELECT a.src, a.dst, a.f, a.p_edge FROM pe a JOIN pe b ON a.src = b.dst AND a.dst = b.src WHERE a.f >= b.f AND a.p_edge > 0)"
C_SQL = W_SQL + ", c AS (SELECT n.i, coalesce(sum(p_edge), 0.0) AS c FROM (SELECT DISTINCT dst AS i FROM pe) n LEFT JOIN want ON want.dst = n.i GROUP BY n.i)"


def _strength(spark, sf_dir) -> DataFrame:
    t = engine_tests(spark, sf_dir)
    return granger.incident_strength(t.select(F.col("dst").alias("i")).distinct(), granger.candidates(t))


@query(f"WITH {W_SQL} SELECT src, dst, round(f, 5) AS f, round(p_edge, 5) AS p_edge FROM want")
def candidate_edges_w(spark, sf_dir):
    return rounded(granger.candidates(engine_tests(spark, sf_dir)), "f", "p_edge", digits=5)


@query(f"WITH {C_SQL} SELECT i, round(c, 6) AS c FROM c")
def incident_strength(spark, sf_dir):
    return rounded(_strength(spark, sf_dir), "c")


@query(f"WITH {C_SQL}, m AS (SELECT ceil(min(c)) AS m FROM c) SELECT i FROM c, m WHERE c < m OR (c <= m AND NOT EXISTS (SELECT 1 FROM c, m WHERE c < m))")
def layer0_select(spark, sf_dir):
    return granger.first_layer(_strength(spark, sf_dir))


G_SQL = """
gp AS (SELECT l_suppkey % 9 AS src, l_partkey % 9 AS dst, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
gt AS (SELECT count(*) AS pairs, sum(q) AS q, sum(n) AS n, sum(r) AS r FROM gp),
ga AS (SELECT src, dst FROM gp, gt WHERE gp.q * pairs > gt.q),
gb AS (SELECT src, dst FROM gp, gt WHERE gp.r * gt.n > gt.r * gp.n),
gn AS (SELECT CAST(unnest(range(12)) AS BIGINT) AS i)"""


def two_graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of suppliers to classes of parts: pairs of more than mean quantity, pairs returned more than the rest; twelve nodes."""
    d = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("src"), (F.col("l_partkey") % 9).alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    total = d.agg(F.count("*").alias("pairs"), F.sum("q").alias("q_all"), F.sum("n").alias("n_all"), F.sum("r").alias("r_all"))
    d = d.crossJoin(F.broadcast(total))  # one row
    return d.filter("q * pairs > q_all").select("src", "dst"), d.filter("r * n_all > r_all * n").select("src", "dst"), spark.range(12).withColumnRenamed("id", "i")


@query(f"WITH {G_SQL} SELECT src, dst FROM ga UNION SELECT src, dst FROM gb")
def graph_union(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    return graph.union(a, b)


@query(f"""WITH {G_SQL}, x AS (SELECT * FROM ga WHERE src <> dst), y AS (SELECT * FROM gb WHERE src <> dst)
SELECT src, dst, 'correct' AS kind FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT src, dst, 'missed' FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT src, dst, 'extra' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def edges_correct_missed_extra(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    return graph.compare(a, b)


@query(f"WITH {G_SQL} SELECT src, dst FROM ga UNION SELECT i, i FROM gn")
def self_loops_add(spark, sf_dir):
    a, _, n = two_graphs(spark, sf_dir)
    return graph.with_loops(a, n)


@query(f"WITH {G_SQL} SELECT src, dst FROM ga WHERE src <> dst")
def self_loops_remove(spark, sf_dir):
    return graph.without_loops(two_graphs(spark, sf_dir)[0])


@query(f"WITH {G_SQL} SELECT src, dst FROM ga WHERE (src + dst) % 3 <> 0")
def zero_filter_drop(spark, sf_dir):
    a, _, _ = two_graphs(spark, sf_dir)
    b = F.when((F.col("src") + F.col("dst")) % 3 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.5)))
    return graph.drop_zero_filters(a.withColumn("b", b)).select("src", "dst")


@query(f"WITH {G_SQL} SELECT i FROM gn WHERE i NOT IN (SELECT src FROM ga) AND i NOT IN (SELECT dst FROM ga)")
def isolated_nodes(spark, sf_dir):
    a, _, n = two_graphs(spark, sf_dir)
    return graph.isolated(n, a)


@query(f"WITH {G_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ga WHERE src <> dst")
def orient_edges(spark, sf_dir):
    return graph.orient(two_graphs(spark, sf_dir)[0])


@query(f"WITH {G_SQL} SELECT a.i AS src, b.i AS dst FROM gn a CROSS JOIN gn b")
def complete_digraph(spark, sf_dir):
    return graph.complete(two_graphs(spark, sf_dir)[2])


@query(f"WITH {G_SQL} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS out FROM ga GROUP BY src")
def adjacency_lists(spark, sf_dir):
    return graph.adjacency_lists(two_graphs(spark, sf_dir)[0]).select("src", F.array_join("out", ",").alias("out"))


@query("""WITH e AS (SELECT date_part('month', l_shipdate) AS k, l_suppkey % 9 AS src, l_partkey % 9 AS dst FROM lineitem GROUP BY ALL HAVING avg(l_quantity) > 25)
SELECT src, dst, round(count(*)::DOUBLE / (SELECT count(DISTINCT k) FROM e), 6) AS freq FROM e WHERE src <> dst GROUP BY src, dst""")
def mean_adjacency(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("k"), (F.col("l_suppkey") % 9).alias("src"), (F.col("l_partkey") % 9).alias("dst")).agg(F.avg("l_quantity").alias("q")).filter("q > 25")
    return rounded(graph.mean_adjacency(d, ["k"]), "freq")


@query(f"""WITH {G_SQL}, e AS (SELECT src AS i, 1 AS o, 0 AS n FROM ga WHERE src <> dst UNION ALL SELECT dst, 0, 1 FROM ga WHERE src <> dst)
SELECT i, sum(o)::BIGINT AS out_degree, sum(n)::BIGINT AS in_degree, count(*) AS degree FROM e GROUP BY i ORDER BY degree DESC, i LIMIT 5""")
def degree_topk(spark, sf_dir):
    return graph.degrees(two_graphs(spark, sf_dir)[0]).orderBy(F.col("degree").desc(), "i").limit(5)


PATH_SQL = G_SQL + """, e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ga WHERE src <> dst)"""


@query(f"""WITH RECURSIVE {PATH_SQL}, w AS (SELECT src AS a, dst AS d FROM e UNION ALL SELECT w.a, e.dst FROM w JOIN e ON w.d = e.src) SELECT a, d, count(*) AS paths FROM w GROUP BY a, d""")
def path_counts(spark, sf_dir):
    return graph.walks(graph.orient(two_graphs(spark, sf_dir)[0]).persist(), 8).select("a", "d", F.col("paths").cast("long").alias("paths"))


@query(f"""WITH RECURSIVE {PATH_SQL}, w AS (SELECT src AS a, dst AS d FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON w.d = e.src) SELECT d AS i, count(*) AS ancestors FROM w GROUP BY d""")
def ancestors_recursive(spark, sf_dir):
    graph.orient(two_graphs(spark, sf_dir)[0]).createOrReplaceTempView("causeway_dag")
    return spark.sql("WITH RECURSIVE w(a, d, n) AS (SELECT src, dst, 1 FROM causeway_dag UNION ALL SELECT w.a, e.dst, n + 1 FROM w JOIN causeway_dag e ON w.d = e.src WHERE n < 9) SELECT d AS i, count(DISTINCT a) AS ancestors FROM w GROUP BY d")


K_SQL = G_SQL + """, x AS (SELECT * FROM ga WHERE src <> dst), y AS (SELECT * FROM gb WHERE src <> dst),
q AS (SELECT (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS tp, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS fp, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS fn)"""


@query(f"WITH {K_SQL} SELECT tp, fp, fn, 81 - tp - fn - fn AS tn FROM q")
def confusion_compat(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    return metrics.confusion(a, b, 9, compat=True)


@query(f"""WITH {K_SQL}, c AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, (72 - tp - fn - fp)::DOUBLE AS tn FROM q)
SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(fp / (tp + fp), 6) AS fdr FROM c""")
def graph_scores(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    return rounded(metrics.scores(metrics.confusion(a, b, 9)).select("f1", "mcc", "fdr"), "f1", "mcc", "fdr")


@query(f"""WITH {G_SQL}, j AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.src IS NOT NULL AS ina, b.src IS NOT NULL AS inb FROM ga a FULL JOIN gb b ON a.src = b.src AND a.dst = b.dst)
SELECT src, dst, (CASE WHEN ina THEN src + 1 ELSE 0 END - CASE WHEN inb THEN dst ELSE 0 END)::DOUBLE AS e1, (CASE WHEN ina THEN 0.5 ELSE 0 END)::DOUBLE AS e2 FROM j""")
def coef_error_outer(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    e = graph.coefficient_errors(a.withColumn("b", F.array((F.col("src") + 1).cast("double"), F.lit(0.5))), b.withColumn("b", F.array(F.col("dst").cast("double"))))
    return e.select("src", "dst", F.get("err", F.lit(0)).alias("e1"), F.coalesce(F.get("err", F.lit(1)), F.lit(0.0)).alias("e2"))


@query(f"""WITH {G_SQL}, j AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.src IS NOT NULL AS ina, b.src IS NOT NULL AS inb FROM ga a FULL JOIN gb b ON a.src = b.src AND a.dst = b.dst)
SELECT round(avg(CASE WHEN ina THEN pow((src + 1 - CASE WHEN inb THEN dst ELSE 0 END - 0.5) / 2, 2) ELSE 0 END), 6) AS error FROM j""")
def filter_error(spark, sf_dir):
    a, b, _ = two_graphs(spark, sf_dir)
    e = graph.coefficient_errors(a.withColumn("b", F.array((F.col("src") + 1).cast("double"), F.lit(0.5))), b.withColumn("b", F.array(F.col("dst").cast("double"))))
    return rounded(metrics.filter_error(e), "error")


@query(f"WITH {G_SQL} SELECT 1 AS lag, dst, src, (src + 1)::DOUBLE AS b FROM ga UNION ALL SELECT 2, dst, src, 0.5::DOUBLE FROM ga")
def graph_to_var(spark, sf_dir):
    a, _, _ = two_graphs(spark, sf_dir)
    return graph.lagged_entries(a.withColumn("b", F.array((F.col("src") + 1).cast("double"), F.lit(0.5))))


@query(f"""WITH {G_SQL}, s AS (SELECT l_suppkey % 9 AS i, date_part('month', l_shipdate) AS m, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS x FROM lineitem GROUP BY ALL)
SELECT dst, src, round(sum(x), 2) AS total, count(*) AS steps FROM ga JOIN s ON src = i GROUP BY dst, src""")
def predecessor_series(spark, sf_dir):
    a, _, _ = two_graphs(spark, sf_dir)
    s = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("i"), F.month("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("x"))
    p = graph.parents(a, panel.to_series(s)).select("dst", F.explode("parents").alias("p"))
    return p.select("dst", "p.src", F.round(F.aggregate("p.xs", F.lit(0.0), lambda u, v: u + v), 2).alias("total"), F.size("p.xs").cast("long").alias("steps"))


@query("SELECT r_regionkey AS i, r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def node_attach(spark, sf_dir):
    nodes = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("i"), "r_name")
    return graph.attach(nodes, read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("i")).agg(F.count("*").alias("nations")))


@query(f"""WITH {E_SQL}, d AS (SELECT t // 168 AS trial, t, i, x - avg(x) OVER (PARTITION BY t // 168, i) AS y FROM panel)
SELECT trial, t, i, round(y / nullif(stddev_pop(y) OVER (PARTITION BY trial), 0), 6) AS x FROM d""")
def normalise_trial(spark, sf_dir):
    d = events_panel(spark, sf_dir).withColumn("trial", F.floor(F.col("t") / 168))
    return rounded(panel.normalise_trial(d, ["trial"], dither=0.0), "x").select("trial", "t", "i", "x")


@query(f"""WITH {Z_SQL}, s AS (SELECT t, sum(x) AS s FROM z GROUP BY t)
SELECT a.t, a.i, round(a.x - 0.5 * b.x - 0.25 * c.x - 0.1 * (s.s - b.x), 6) AS r FROM z a JOIN z b ON b.i = a.i AND b.t = a.t - 1 JOIN z c ON c.i = a.i AND c.t = a.t - 2 JOIN s ON s.t = a.t - 1""")
def one_step_residuals(spark, sf_dir):
    d = z_panel(spark, sf_dir).persist()
    own = F.col("src") == F.col("dst")
    b = F.array(F.when(own, 0.5).otherwise(0.1), F.when(own, 0.25).otherwise(0.0))
    return rounded(refit.one_step_residuals(d, graph.complete(d.select("i").distinct()).withColumn("b", b), 2), "r")


@query("SELECT round(ln(sum(s_acctbal + 2000)) / ln(sum(s_nationkey + 2)), 6) AS lre FROM supplier")
def log_relative_error(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select((F.col("s_acctbal") + 2000).alias("sv2_hat"), (F.col("s_nationkey") + 2).alias("sv2"))
    return rounded(metrics.log_relative_error(s), "lre")


@query("""WITH d AS (SELECT l_returnflag AS cell, l_orderkey AS iter, max(l_quantity) - max(l_tax * 500) AS d FROM lineitem GROUP BY 1, 2)
SELECT cell, count(d) AS n, round(avg(d), 6) AS diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM d GROUP BY cell""")
def paired_t_stat(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_orderkey").alias("iter"), F.col("l_quantity").alias("a"), (F.col("l_tax") * 500).alias("b"))
    return rounded(metrics.paired_t(d, ["cell"], "iter", "a", "b").select("cell", "n", "diff", "t"), "diff", "t")


P_SQL = "p AS (SELECT vec_id, label AS truth, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS guess FROM embeddings)"


def predictions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("guess"))


@query(f"WITH {P_SQL}, c AS (SELECT truth, guess, count(*) AS c FROM p GROUP BY ALL) SELECT truth, guess, c, round(c::DOUBLE / sum(c) OVER (PARTITION BY truth), 6) AS share FROM c")
def confusion_matrix_rownorm(spark, sf_dir):
    return rounded(metrics.confusion_by_class(predictions(spark, sf_dir), "truth", "guess"), "share")


@query(f"""WITH {P_SQL}, t AS (SELECT truth AS k, count(*)::DOUBLE AS t FROM p GROUP BY 1), g AS (SELECT guess AS k, count(*)::DOUBLE AS p FROM p GROUP BY 1),
s AS (SELECT sum(coalesce(t, 0) * coalesce(p, 0)) AS tp, sum(coalesce(t, 0) * coalesce(t, 0)) AS tt, sum(coalesce(p, 0) * coalesce(p, 0)) AS pp, max(t) AS top FROM t FULL JOIN g USING (k)),
n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE truth = guess)::DOUBLE AS c FROM p)
SELECT round(c / n, 6) AS accuracy, round((c * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc, round(top / n, 6) AS prevalence FROM s, n""")
def multiclass_scores(spark, sf_dir):
    return rounded(metrics.multiclass_mcc(predictions(spark, sf_dir), "truth", "guess"), "accuracy", "mcc", "prevalence")


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM embeddings")
def stratified_split(spark, sf_dir):
    return metrics.stratified_split(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("SELECT o_orderpriority AS cell, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\" FROM orders GROUP BY 1")
def metric_pivot(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("value"))
    return rounded(metrics.pivot_metrics(d, ["cell"], names=["F", "O"]), "F", "O", digits=4)


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def metric_unpivot(spark, sf_dir):
    return metrics.melt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT s_suppkey, s_nationkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sector_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name", "r_name")


# What SQL cannot express: recursions chosen by a criterion, greedy recovery, fits and simulations.


def _series(spark, sf_dir, node: str = "event_type") -> tuple[DataFrame, int, int]:
    """Standardised series, their number and length."""
    s = pipeline.prepared(events_panel(spark, sf_dir, node)).persist()
    n, t = s.agg(F.count("*"), F.max(F.size("xs"))).first()
    return s, n, t


@query()
def pairwise_gc_fast(spark, sf_dir):
    return pipeline.tests_by_class(events_values(spark, sf_dir, "user_id"), 3600, 10, "t", "user_id", "x")


@query()
def pairwise_gc_lineitem(spark, sf_dir):
    return pipeline.tests_by_class(items_values(spark, sf_dir), 1, 10, "t", "l_suppkey", "x")


@query()
def pairwise_gc_slow(spark, sf_dir):
    s, _, t = _series(spark, sf_dir)
    return granger.score_pairs(covariance.pairwise_slow(s, 5), t, f_mode=True)


def _planted(spark, sf_dir) -> tuple[DataFrame, int, int]:
    s = pipeline.prepared(planted_panel(spark, sf_dir)).persist()
    n, t = s.agg(F.count("*"), F.max(F.size("xs"))).first()
    return s, n, t


@query(PLANTED_EDGES)
def pw_scg(spark, sf_dir):
    """The graph recovered from the planted system; its SQL states the graph that was planted."""
    s, n, t = _planted(spark, sf_dir)
    return pipeline.recover(pipeline.tests(s, n, t, 5))


@query(PLANTED_EDGES)
def pwgc_edges(spark, sf_dir):
    """The same by the whole estimate, refit included: edges with a filter that is not zero, loops aside."""
    s, n, t = _planted(spark, sf_dir)
    return graph.without_loops(graph.drop_zero_filters(refit.filters(pipeline.estimate_graph(s, n, t, 5, f_cdf=True)))).select("src", "dst")


@query()
def pwgc_graph(spark, sf_dir):
    """Fitted edges, loops included, of the planted system."""
    s, n, t = _planted(spark, sf_dir)
    return refit.filters(pipeline.pwgc_estimate(s, n, t, 5))


@query(f"""WITH {PLANTED_SQL}, e(dst, src) AS (VALUES {', '.join(f'({d}, {s})' for s, d in PLANTED)}),
l AS (SELECT i, t, x, lag(x) OVER (PARTITION BY i ORDER BY t) AS l FROM z),
m AS (SELECT dst, src, sum(o.l * o.l) AS oo, sum(o.l * q.l) AS oq, sum(q.l * q.l) AS qq, sum(o.x * o.l) AS xo, sum(o.x * q.l) AS xq FROM e JOIN l o ON o.i = dst JOIN l q ON q.i = src AND q.t = o.t WHERE o.l IS NOT NULL GROUP BY ALL),
c AS (SELECT dst, dst AS src, (xo * qq - xq * oq) / (oo * qq - oq * oq) AS b FROM m UNION ALL SELECT dst, src, (xq * oo - xo * oq) / (oo * qq - oq * oq) FROM m
  UNION ALL SELECT i, i, sum(x * l) / sum(l * l) FROM l WHERE l IS NOT NULL AND i NOT IN (SELECT dst FROM e) GROUP BY i),
f AS (SELECT c.dst, o.t, any_value(o.x) - sum(b * q.l) AS r FROM c JOIN l o ON o.i = c.dst JOIN l q ON q.i = c.src AND q.t = o.t WHERE o.l IS NOT NULL GROUP BY ALL),
v AS (SELECT dst, var_pop(r) AS sv2_hat FROM f GROUP BY dst)
SELECT CAST(c.src AS BIGINT) AS src, CAST(c.dst AS BIGINT) AS dst, round(b, 6) AS b, round(sv2_hat, 6) AS sv2_hat FROM c JOIN v ON v.dst = c.dst""")
def refit_known(spark, sf_dir):
    """Least squares on the planted edges and loops, one lag; its SQL solves the normal equations."""
    s, _, _ = _planted(spark, sf_dir)
    edges = spark.createDataFrame(list(PLANTED), "src long, dst long")
    fitted = refit.estimate(graph.with_loops(edges, s.select("i")), s, 1)
    each = refit.filters(fitted).select("src", "dst", F.get("b", F.lit(0)).alias("b"))
    return rounded(each.join(fitted.select("dst", "sv2_hat"), "dst").select("src", "dst", "b", "sv2_hat"), "b", "sv2_hat")


@query()
def joint_alasso(spark, sf_dir):
    """All equations of the planted system under one penalty."""
    s, _, _ = _planted(spark, sf_dir)
    return pipeline.joint_alasso(s, 2)


@query()
def lstsq_refit(spark, sf_dir):
    s, n, t = _planted(spark, sf_dir)
    return pipeline.estimate_graph(s, n, t, 5, max_t=t // 2).select("dst", "sv2_hat", "srcs")


@query()
def lasso_refit(spark, sf_dir):
    s, n, t = _planted(spark, sf_dir)
    return graph.drop_zero_filters(refit.filters(pipeline.estimate_graph(s, n, t, 5, method="lasso")))


@query()
def threshold_graph(spark, sf_dir):
    s, n, t = _planted(spark, sf_dir)
    return pipeline.threshold_graph(s, n, t, 5).select("dst", "sv2_hat", "srcs")


def _dense(spark, sf_dir, method: str, **more) -> DataFrame:
    s, _, _ = _planted(spark, sf_dir)
    return graph.drop_zero_filters(refit.filters(pipeline.dense_graph(s, 2, method, **more)))


@query()
def alasso_dense(spark, sf_dir):
    return _dense(spark, sf_dir, "alasso", post_ols=True)


@query()
def lasso_dense(spark, sf_dir):
    return _dense(spark, sf_dir, "lasso")


@query()
def glasso_dense(spark, sf_dir):
    return _dense(spark, sf_dir, "glasso")


@query()
def ar_baseline_oos(spark, sf_dir):
    s, _, t = _series(spark, sf_dir)
    return refit.ar_baseline(s, 5, t * 2 // 3)


@query()
def stationarity(spark, sf_dir):
    return diagnostics.stationarity(_series(spark, sf_dir)[0])


@query()
def heavy_tails(spark, sf_dir):
    return diagnostics.heavy_tails(_series(spark, sf_dir)[0])


@query()
def out_of_sample_demo(spark, sf_dir):
    s, n, t = _planted(spark, sf_dir)
    edges = pipeline.recover(pipeline.tests(s, n, t, 5))
    return diagnostics.out_of_sample(graph.with_loops(edges, s.select("i")), s, 5, t * 2 // 3)


@query()
def frequency_response(spark, sf_dir):
    return diagnostics.frequency_response(spark, simulate.simulate("scg", 4, 10, 2, 0, 3)[1], 16)


def _trials(spark, sf_dir) -> DataFrame:
    """The planted system cut into trials of 250 days; two are a subject."""
    p = panel.zscore(planted_panel(spark, sf_dir)).withColumn("trial", F.floor(F.col("t") / 250)).withColumn("subject", F.floor(F.col("trial") / 2))
    return p.groupBy("subject", "trial", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda r: r.x).alias("xs"))


@query()
def subject_graphs(spark, sf_dir):
    return pipeline.graphs_by_group(_trials(spark, sf_dir), ["subject", "trial"], 3)


@query()
def subject_graphs_threshold(spark, sf_dir):
    return pipeline.graphs_by_group(_trials(spark, sf_dir), ["subject", "trial"], 3, "threshold")


@query()
def subject_graphs_alasso(spark, sf_dir):
    return pipeline.graphs_by_group(_trials(spark, sf_dir), ["subject", "trial"], 2, "alasso")


@query()
def iterated_pwgc(spark, sf_dir):
    return pipeline.graphs_by_group(_trials(spark, sf_dir), ["subject", "trial"], 3, "iterated")


@query()
def rolling_refit(spark, sf_dir):
    """One graph a window of seven blocks of a hundred days."""
    d = panel.zscore(planted_panel(spark, sf_dir)).withColumn("day", F.floor(F.col("t") / 100)).persist()
    days = d.agg(F.max("day")).first()[0] + 1
    w = panel.rolling_windows(d, "day", days, 7).groupBy("window_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda r: r.x).alias("xs"))
    return pipeline.graphs_by_group(w, ["window_id"], 3)


@query(f"WITH {G_SQL}, e AS (SELECT DISTINCT src, dst FROM ga WHERE src <> dst), {engine_sql.pagerank(20)} SELECT i, round(r, 6) AS r FROM rank")
def pagerank(spark, sf_dir):
    a, _, n = two_graphs(spark, sf_dir)
    return rounded(graph.pagerank(materialize(a, "edges"), n), "r")


@query()
def rolling_prediction(spark, sf_dir):
    """What the graph of seven blocks of days explains of the next one, by node."""
    d = panel.zscore(planted_panel(spark, sf_dir)).withColumn("day", F.floor(F.col("t") / 100))
    return pipeline.rolling_prediction(d, 8, 2)


@query()
def trial_graphs(spark, sf_dir):
    """Trials normalised with a little noise added, 200 steps of each, five lags."""
    d = planted_panel(spark, sf_dir).withColumn("trial", F.floor(F.col("t") / 250))
    return pipeline.trial_graphs(d, ["trial"])


@query(f"""WITH {Z_SQL}, d AS (SELECT i, x - lag(x) OVER w AS y, lag(x) OVER w AS l FROM z WINDOW w AS (PARTITION BY i ORDER BY t)),
gr AS (SELECT i, count(*)::DOUBLE AS n, regr_slope(y, l) AS b, regr_sxx(y, l) AS sxx, regr_syy(y, l) AS syy, regr_sxy(y, l) AS sxy FROM d WHERE y IS NOT NULL GROUP BY i)
SELECT i, round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 5) AS adf FROM gr""")
def stationarity_plain(spark, sf_dir):
    """The unit-root statistic without lagged differences; `stationarity` chooses their number."""
    return rounded(diagnostics.stationarity(_series(spark, sf_dir)[0], 0).select("i", "adf"), "adf", digits=5)


@query()
def coupled_demo(spark, sf_dir):
    """Three loops of their own, the third driving the others from step 150 on."""
    return simulate.demo_series(spark, coupled=True)


@query()
def subject_pair(spark, sf_dir):
    """Tells trials of the planted system from those of the same system with its nodes moved round, by their graphs."""
    t = panel.zscore(planted_panel(spark, sf_dir)).withColumn("trial", F.floor(F.col("t") / 100))
    t = t.withColumn("subject", F.when(F.col("trial") % 2 == 0, "a").otherwise("b")).withColumn("i", F.when(F.col("trial") % 2 == 0, F.col("i")).otherwise((F.col("i") + 3) % 7))
    t = t.groupBy("subject", "trial", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda r: r.x).alias("xs"))
    e = pipeline.graphs_by_group(t, ["subject", "trial"], 2)
    rows = materialize(classify.features(e, t.select("subject", "trial").distinct(), ["subject", "trial"], list(range(7))), "features")
    return classify.subject_pair(rows, "a", "b", "subject", "trial", tries=1, folds=2, parts=(8,))


@query()
def var_simulate(spark, sf_dir):
    return simulate.simulated_series(spark, [{"kind": k, "n": 8, "t": 400, "p": 3, "q": 0.2} for k in ("scg", "dag", "digraph")]).select("system", "i", F.size("xs").alias("t"), F.array_max("xs").alias("top"))


@query()
def var_acf(spark, sf_dir):
    """Theoretical and sample autocovariance of a simulated system."""
    x, b, sv2 = simulate.simulate("scg", 4, 4000, 2, 0, 3)
    r, s = simulate.Var(b).acf(np.diag(sv2), 3), None
    from ..functions import autoregression as ar

    s = ar.covariances(x - x.mean(0), 3)
    return spark.createDataFrame(pd.DataFrame([(k, i, j, float(r[k, i, j]), float(s[k, i, j])) for k in range(4) for i in range(4) for j in range(4)], columns=["tau", "i", "j", "r", "sample"]))


@query()
def var_stability(spark, sf_dir):
    rows = []
    for k in range(8):
        v = simulate.Var(simulate.normal_coefficients(6, 2, 0.3, np.random.default_rng(k)))
        rows.append((k, v.radius(), v.stable(), v.stabilised(0.5).radius()))
    return spark.createDataFrame(rows, "system long, radius double, stable boolean, scaled double")


@query()
def random_scg(spark, sf_dir):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(k, s, d, scg.is_strongly_causal(e)) for k in range(5) for e in [simulate.random_tree(10, rng)] for s, d in e], "graph long, src long, dst long, strongly_causal boolean")


@query()
def random_dag(spark, sf_dir):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(k, s, d) for k in range(5) for s, d in simulate.random_dag(10, 0.2, rng)], "graph long, src long, dst long")


@query()
def monte_carlo_table(spark, sf_dir):
    return experiments.table(experiments.run(experiments.grid(spark, n=(10,), t=(120,), q=(None, 0.2), iterations=4, p=2, p_most=4)))


@query()
def graph_classifier(spark, sf_dir):
    """Predicts which half of the month a trial is from, by its graph."""
    t = _trials(spark, sf_dir).persist()
    e = pipeline.graphs_by_group(t, ["subject", "trial"], 2)
    groups = t.select("subject", "trial").distinct().withColumn("label", F.when(F.col("trial") < 5, "first").otherwise("second"))
    names = sorted(r[0] for r in t.select("i").distinct().collect())
    f = classify.features(e, groups, ["subject", "trial"], names)
    return classify.classify(f, "label", "trial", 0.3, grid=(0.1,))
