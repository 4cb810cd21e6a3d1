"""Distribution functions for SQL, as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import special


def register(spark: SparkSession) -> None:
    """chi2_cdf(x, df), f_cdf(x, d1, d2), t_cdf(x, df) and edge_probability(f, p) for this session."""

    @F.pandas_udf("double")
    def chi2_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.chi2_cdf(x.to_numpy(float), df.to_numpy(float)))

    @F.pandas_udf("double")
    def f_cdf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(special.f_cdf(x.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))

    @F.pandas_udf("double")
    def t_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.t_cdf(x.to_numpy(float), df.to_numpy(float)))

    @F.pandas_udf("double")
    def edge_probability(f: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(special.edge_probability(f.to_numpy(float), p.to_numpy(float)))

    for name, f in (("chi2_cdf", chi2_cdf), ("f_cdf", f_cdf), ("t_cdf", t_cdf), ("edge_probability", edge_probability)):
        spark.udf.register(name, f)
