"""Five chained stages over ``documents``: language ID, line dedup, SimHash near-dedup, PII, packing.

Every stage works on all rows its predecessor kept, and all but the last return
the columns of ``documents``, whatever further columns there are. Empty tables give
empty results; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprout.llm import langid, lines, packing, pii, simhash
from sprout.llm.common import documents, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those told to be in none of the languages of the labelled rows.

    The measure doesn't depend on a text's size, and texts too short to tell stay; without
    a labelled row all texts with a letter stay. Null and empty texts go, repeated rows are
    judged alike.
    """
    return langid.belonging(docs, langid.fit(docs, typical=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that occur on many sources from all texts that have another line.

    No row goes; null and empty texts stay as they are, repeated rows change alike.
    """
    return lines.remove_boilerplate(docs, report=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash group.

    Of rows that share an id one stays: the one with the least text in code-point order
    (null first), then the least other columns. Null and empty texts are one group. Rows
    without an id stay.
    """
    found, _ = store(simhash.near_duplicates(docs, shingle=4, max_bits=4), "near-dedup")
    flags = (found.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("later"), (F.count("*") > 1).alias("repeated"))
             .where("later OR repeated").withColumnRenamed("doc_id", "id"))
    # ids that were seen more than once are few: only their rows are compared
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    flagged = docs.select(row, F.col("doc_id").alias("own"), F.col("text").alias("text")).join(flags, F.col("own") == F.col("id"), "left")
    once = flagged.where("later IS NULL").select("row")
    repeated = flagged.where("repeated AND NOT later").groupBy("own").agg(F.min(F.struct("text", "row")).alias("least")).select("least.row")
    return once.unionByName(repeated).select("row.*")


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by keyed surrogates.

    No row goes; null and empty texts stay as they are, equal rows get equal texts.
    """
    return pii.pseudonymise(docs, report=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack the documents that are left: a row per piece.

    A null or empty text is one piece of its end token; rows that repeat an id have their
    own pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("pii_surrogates", pii_surrogates), ("best_fit_packing", best_fit_packing)]
#: Fitted classifier and packing search have no SQL form; a test holds run() against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the stored rows of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
