"""Documents to training tokens in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Between stages the documents are written as Parquet to the shared folder and read again, so a lost executor
repeats work of one stage at most. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import bpe, mixing, pii, quality_classifier, simhash
from causeway.llm._shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, predicts to be good.

    Every row is judged by its text alone, whatever its other columns and their names: null and empty texts get the
    model's bias, repeated rows the same verdict. Without usable labels all rows score 0.5 and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by SimHash, the one with the smallest doc_id (null last).

    Rows are told apart by their place, so null and repeated ids neither join groups nor lose rows; of repeated rows
    one stays. Null, empty and blank texts are one group, with whatever lies within four bits of fingerprint zero.
    """
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind.

    A null text stays null, an empty one empty; where there is a column n_chars it is counted anew. Other columns and
    repeated rows pass through.
    """
    return pii.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row as often as it is taken, so not at all, once or twice.

    Rows without a word go, as they add nothing to any target. A null source is a source of its own, repeated rows
    draw apart. Weights come from the texts, as no stage before may add a column of scores.
    """
    return mixing.mixture(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix, repeats included.

    A null text counts as empty: no tokens. Other columns are ignored.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixing_sources),
    ("byte-level BPE", byte_bpe),
]

#: Language models, hashes of shingles and byte pairs are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
