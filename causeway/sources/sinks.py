"""Writers of graphs, systems, tables and errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def adjacency(edges: DataFrame, path: str, by: str = "subject") -> None:
    edges.write.mode("overwrite").partitionBy(by).parquet(path)


def system(spark: SparkSession, path: str, x: np.ndarray, b: np.ndarray, sv2: np.ndarray, **params) -> None:
    """panel, edges and params of a simulated system."""
    t, n = x.shape
    spark.createDataFrame([(int(i), x[:, i].tolist()) for i in range(n)], "i long, xs array<double>").select("i", F.posexplode("xs").alias("t", "x")).write.mode("overwrite").parquet(f"{path}/panel")
    edges = [(int(s), int(d), b[:, d, s].tolist()) for d, s in np.argwhere((b != 0).any(0))]
    spark.createDataFrame(edges, "src long, dst long, b array<double>").write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame([(n, t, b.shape[0], sv2.tolist(), {k: str(v) for k, v in params.items()})], "n int, t int, p int, sv2 array<double>, params map<string,string>").write.mode("overwrite").parquet(f"{path}/params")


def latex(table: DataFrame, columns: list[str], bold: dict[str, str] | None = None, digits: int = 2) -> str:
    """A small result table as LaTeX. bold: value column -> boolean column."""
    def cell(row, c: str) -> str:
        v = row[c]
        text = "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return rf"\textbf{{{text}}}" if bold and c in bold and row[bold[c]] else text

    lines = [" & ".join(cell(r, c) for c in columns) + r" \\" for r in table.collect()]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(columns) + r" \\ \hline", *lines, r"\end{tabular}"])


def errors(rows: DataFrame, path: str) -> None:
    """Appends; what was logged before stays."""
    rows.write.mode("append").json(path)
