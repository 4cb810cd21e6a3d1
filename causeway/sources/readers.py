"""Readers of series, universes, trials and graphs."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stocks(spark: SparkSession, folder: str, symbols: DataFrame | None = None, pattern: str = "*.txt") -> DataFrame:
    """One CSV a ticker, with Date, Close and Volume among its columns, in any order and any case; symbol is the file name up to the first dot.

    Each file is read by its own header, as one value (a ticker's file is small); fields hold no commas. Empty files,
    and files without a Date, give no rows; a column that a file lacks is null. symbols: a table of symbols to keep.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    raw = raw.select(F.lower(F.split(F.col("_metadata.file_name"), r"\.")[0]).alias("symbol"), F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n").alias("lines"))
    if symbols is not None:
        raw = raw.join(symbols.select(F.lower("symbol").alias("symbol")), "symbol", "left_semi")
    head = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda x: F.lower(F.trim(x)))
    rows = raw.withColumn("head", head).select("symbol", "head", F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    cell = lambda name, kind: F.expr(f"try_cast(trim(get(split(line, ','), cast(array_position(head, '{name}') - 1 AS int))) AS {kind})").alias(name)
    return rows.select("symbol", cell("date", "date"), cell("close", "double"), cell("volume", "double")).filter("date IS NOT NULL")


def sentiment(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.lower("symbol").alias("symbol"), F.to_date("date").alias("date"), F.col("sentiment_signal").cast("double").alias("sentiment")).orderBy("symbol", "date")


def universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Symbol string, Name string, Sector string").csv(path).withColumnsRenamed({"Symbol": "symbol", "Name": "name", "Sector": "sector"})


def two_row_header(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV with two header rows (ticker, field) as ts, ticker, field, value; rows: as many of the first ones, if given."""
    text = spark.read.text(path)
    head = [r[0].split(",") for r in text.limit(2).collect()]
    raw = spark.read.csv(path)
    tickers, fields, last = [], head[1][1:], ""
    for t in head[0][1:]:
        last = t or last
        tickers.append(last)
    data = raw.filter(F.try_to_timestamp("_c0").isNotNull())
    data = data.limit(rows) if rows is not None else data
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(f).alias("field"), F.expr(f"try_cast(_c{k + 1} AS double)").alias("value")) for k, (t, f) in enumerate(zip(tickers, fields))]))
    return data.select(F.try_to_timestamp("_c0").alias("ts"), cells.alias("c")).select("ts", "c.*")


def trial(spark: SparkSession, path: str, channels: list[str] | None = None) -> DataFrame:
    """Blank-separated trials with # comments: file, i (channel), t and x."""
    raw = spark.read.option("sep", " ").option("comment", "#").schema("trial int, chan string, time int, nv double").csv(path)
    out = raw.select(F.col("_metadata.file_name").alias("file"), F.col("chan").alias("i"), F.col("time").cast("long").alias("t"), F.col("nv").alias("x")).filter("t IS NOT NULL")
    return out.filter(F.col("i").isin(channels)) if channels else out


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Stored graphs as edges; unreadable files are passed over."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def adjacency_arrays(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """file, src, dst and weight of the non-zero cells of stored square matrices (row: source); files that are none are passed over."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("_metadata.file_name").alias("file"), "content")

    def apply(batches):
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                try:
                    m = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                if m.ndim == 2 and m.shape[0] == m.shape[1]:
                    s, d = np.nonzero(m)
                    yield pd.DataFrame({"file": file, "src": s.astype(np.int64), "dst": d.astype(np.int64), "weight": m[s, d].astype(float)})

    return raw.mapInPandas(apply, "file string, src long, dst long, weight double")


def trading_days(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """date of every weekday that is no holiday."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS date").filter(F.weekday("date") < 5)
    return days.join(holidays, "date", "left_anti") if holidays is not None else days


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst) of a GEXF file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id string, _label string").select(F.col("_id").alias("id"), F.col("_label").alias("label"))
    edges = read("edge", "_id string, _source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"))
    return nodes, edges


def subject_class(name) -> F.Column:
    """The class letter of a subject: its fourth character."""
    return F.substring(name, 4, 1)
