"""Graphs as frames: edges (src, dst, ...), nodes (i, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()


def compare(true: DataFrame, found: DataFrame) -> DataFrame:
    """src, dst and kind: correct, missed or extra; self-loops aside."""
    t, f = (x.filter("src <> dst").select("src", "dst").distinct() for x in (true, found))
    tag = lambda d, k: d.withColumn("kind", F.lit(k))
    return tag(t.intersect(f), "correct").union(tag(t.subtract(f), "missed")).union(tag(f.subtract(t), "extra"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(nodes.select(F.col("i").alias("src"), F.col("i").alias("dst"))).distinct()


def drop_zero_filters(edges: DataFrame) -> DataFrame:
    """Edges with a coefficient that is not 0; a missing filter is an error."""
    checked = F.when(F.col("b").isNull(), F.raise_error(F.lit("an edge has no filter"))).otherwise(F.col("b"))
    return edges.filter(F.exists(checked, lambda v: v != 0))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("i")).union(edges.select(F.col("dst").alias("i")))
    return nodes.join(ends.distinct(), "i", "left_anti")


def orient(edges: DataFrame) -> DataFrame:
    """Undirected to directed: from the smaller name to the larger."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def complete(nodes: DataFrame) -> DataFrame:
    """All ordered pairs with loops; n squared rows by definition."""
    return nodes.select(F.col("i").alias("src")).crossJoin(nodes.select(F.col("i").alias("dst")))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("out"))


def mean_adjacency(edges: DataFrame, keys: list[str]) -> DataFrame:
    """src, dst and the share of graphs (one a value of keys) that hold the edge; loops aside."""
    k = edges.select(*keys).distinct().agg(F.count("*").alias("k"))
    counts = edges.filter("src <> dst").select(*keys, "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("c"))
    return counts.crossJoin(F.broadcast(k)).select("src", "dst", (F.col("c") / F.col("k")).alias("freq"))


def degrees(edges: DataFrame) -> DataFrame:
    e = without_loops(edges).select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("i"), F.lit(1).alias("o"), F.lit(0).alias("n")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("i").agg(F.sum("o").alias("out_degree"), F.sum("n").alias("in_degree"), F.count("*").alias("degree"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Damped link analysis; ranks of nodes without links out are shared by all. Each round is written, so lost executors repeat one."""
    e = without_loops(edges).select("src", "dst").distinct()
    n = nodes.count()
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    links = e.join(out, "src").persist()
    rank = nodes.select("i", F.lit(1.0 / n).alias("r"))
    for _ in range(rounds):
        sent = links.join(rank, F.col("src") == F.col("i")).groupBy(F.col("dst").alias("i")).agg(F.sum(F.col("r") / F.col("k")).alias("got"))
        lost = rank.join(out, F.col("i") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        rank = materialize(nodes.select("i").join(sent, "i", "left").crossJoin(F.broadcast(lost)).select("i", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("r")), "rank")
    return rank


def walks(edges: DataFrame, most: int) -> DataFrame:
    """a, d and the number of directed paths from a to d of up to `most` edges (all, in a graph without cycles)."""
    e = without_loops(edges).select("src", "dst")
    now = e.groupBy(F.col("src").alias("a"), F.col("dst").alias("d")).agg(F.count("*").alias("c"))
    total = now
    for _ in range(most - 1):
        now = now.join(e, F.col("d") == F.col("src")).groupBy("a", F.col("dst").alias("d")).agg(F.sum("c").alias("c"))
        total = total.union(now)
    return total.groupBy("a", "d").agg(F.sum("c").alias("paths"))


def attach(nodes: DataFrame, values: DataFrame, strict: bool = True) -> DataFrame:
    """nodes with the columns of values; strict: a node without one is an error."""
    out = nodes.join(values.withColumn("_has", F.lit(True)), "i", "left")
    if strict:
        out = out.withColumn("_has", F.when(F.col("_has").isNull(), F.raise_error(F.lit("a node has no value"))).otherwise(F.col("_has")))
        out = out.filter("_has")
    return out.drop("_has")


def parents(edges: DataFrame, series: DataFrame) -> DataFrame:
    """dst and parents, its predecessors' series in order of name."""
    own = edges.join(series, F.col("src") == F.col("i")).select("dst", F.struct("src", "xs").alias("s"))
    return own.groupBy("dst").agg(F.array_sort(F.collect_list("s")).alias("parents"))


def coefficient_errors(true: DataFrame, found: DataFrame) -> DataFrame:
    """src, dst and err (true - found, by lag) over the union of edges; an absent or shorter filter is 0."""
    t, f = true.select("src", "dst", F.col("b").alias("bt")), found.select("src", "dst", F.col("b").alias("bf"))
    zero = F.array(F.lit(0.0))
    j = t.join(f, ["src", "dst"], "full_outer")
    return j.select("src", "dst", F.zip_with(F.coalesce("bt", zero), F.coalesce("bf", zero), lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))).alias("err"))


def lagged_entries(edges: DataFrame) -> DataFrame:
    """lag (from 1), dst, src and b: the entries of a system's coefficient matrices, from filters (src, dst, b)."""
    return edges.select("dst", "src", F.posexplode("b").alias("k", "b")).select((F.col("k") + 1).alias("lag"), "dst", "src", "b")


def example(spark) -> DataFrame:
    """Six nodes, a strongly causal graph."""
    return spark.createDataFrame([(1, 3), (2, 4), (3, 4), (3, 5), (4, 6)], "src long, dst long")
