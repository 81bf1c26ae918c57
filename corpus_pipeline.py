"""The corpus pipeline: quality rules, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before kept, and is written as Parquet and read again; all but the last return
the columns of documents.  ``STAGES`` and ``run`` are the whole interface.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import entries, near_dedup, packing, quality_rules, scratch, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their lines.

    Lines above the limits are cut out of the others.  See
    ``quality_rules.passing`` for nulls, repeated rows and empty tables.
    """
    entries.prepare(spark)
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8.

    Null and wordless texts and rows without an id stay; see
    ``near_dedup.without_near_duplicates``.
    """
    entries.prepare(spark)
    return near_dedup.without_near_duplicates(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that an earlier place has.

    No row goes, even where all its words do; see
    ``substring_dedup.without_repeats``.
    """
    entries.prepare(spark)
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens.

    A null text is packed as its end token; see ``packing.pack_documents``.
    """
    entries.prepare(spark)
    return packing.pack_documents(docs, entries.tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near-dedup", near_duplicates), ("substring dedup", substrings), ("packing", pack)]
#: The last stage needs the tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    Each stage's rows are written and read again as the next one's documents.
    Null, empty and repeated rows are as each stage says; an empty table gives
    an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch.root(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.stored(stage(spark, docs, sf_dir), f"{root}/stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
