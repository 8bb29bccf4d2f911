"""The corpus pipeline: from raw documents to piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the docs of the next stage.  All stages but
the last keep every column of docs, extra ones and those with names that an
operator uses itself.  Rows are judged by their own whole text, with or without
a doc_id and whatever other rows share it.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table, written
from tidemill.llm.decontamination import drop_contaminated
from tidemill.llm.exact_dedup import drop_exact_copies
from tidemill.llm.jaccard_join import drop_near_copies
from tidemill.llm.piece_dropout import encode
from tidemill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go.

    Null and empty texts take the rate of examples without words, which is
    below the threshold unless most of those are toxic.  Rows that repeat are judged alike.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null id is the least, a null text is empty, of rows equal in both any one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity (five-word shingles, 0.8 or more) the one with the least doc_id stays.

    Rows without a doc_id come last in their group; of rows that share the
    least id the one with the least hash of its text stays.  Rows without words all stay.
    """
    return drop_near_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of ten words of a benchmark item (all its words if it has fewer) go; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of what is left: a row for each; null and empty texts have none."""
    return encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Neither the classifier nor the encoding can be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
