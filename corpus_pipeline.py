"""Documents to packed training sequences, in five stages.

Every stage gets what the one before it kept, read back from Parquet in the
shared folder, and decides on that alone. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.common import stored, table
from opsloom.llm.language import accepted
from opsloom.llm.mixing import mixed
from opsloom.llm.nearcopies import first_of_near_copies
from opsloom.llm.packing import pack
from opsloom.llm.suffixes import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with less than two fifths of their words in sure spans of a language, go."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays: the one with the least id."""
    return first_of_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier too are cut out of the texts."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document comes as often as the draw says."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at the mix's proportions; row_id tells a document's copies apart."""
    return pack(docs, with_ids=False, added=True).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing", mixing), ("packing", packing)]

#: Learned, drawn and tokenized steps have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
