"""Corpus pipeline: filter, deduplicate, mix and pack the documents, stage by stage.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns the
documents for the next stage with their columns; the last returns the packed pieces.

Defined results, stage by stage (each operator's module says more):
null and empty texts have no features and get the chain's base rate, are one text to the
exact stage, near to nothing but each other, one token to the mix and a piece of length 0 to the
packing. Null ids are scored and mixed like others; of rows with one text one stays, with the
smallest id where there is one; the near stage keeps rows without an id. A null source is a
source of its own. Repeated rows are exact copies. Very long texts are read whole. Empty
documents give empty tables, empty labels reject nothing. Further columns, whatever their
names, pass all stages but the last, whose columns are those of the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapline.llm import exact_dedup, length_packing, near_dedup, source_mixing, toxicity
from gapline.llm.tables import table
from gapline.runtime import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; labels come from the table labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, that with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is drawn; small sources repeat, up to the limit of epochs."""
    return source_mixing.mix(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bucket, batch and slot."""
    return length_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("length_packing", pack_lengths),
]

# Classifiers, sketches and hashed orders have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
