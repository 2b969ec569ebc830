"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the former
one kept; its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``documents``, and whatever columns
are there besides.  Repeated rows, nulls in any column, empty and very long texts
and ties are handled as the stages' operators say; an empty table goes through as
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, mixing, near, quality, queries
from rasterloom.llm.common import cleared, crc_bucket, discarded, new_folder, table, written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of the threshold or more; learned from the labels of those in ``docs``, held-out ids aside."""
    rows = written(quality.with_statistics(docs, docs.columns), "pipeline-stats")  # read twice, to learn and to filter
    model = quality.train(*quality.labelled(rows, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5)))
    return quality.accepted(rows, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each component of near copies: five-word similarity of 0.8 or more."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by the weights of domains and languages; a document once for each epoch that it is drawn in."""
    return mixing.drawn(docs, queries.documents_mix())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations: a row for each document and sample."""
    return queries.encoded(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Training, the stream's state and the lattice search are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between is removed as soon as the next stage's rows are written."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        with cleared(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.option("compression", "zstd").parquet(path)
        if former is not None:
            discarded(former)
        docs = former = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
