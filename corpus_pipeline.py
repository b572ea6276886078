"""Documents to training sequences: language, near copies, repeated passages, personal data, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns
of documents; a stage that changes a text also sets n_chars, if there is such a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import langid, packing, pii, simhash, substrings
from pagelore.llm.common import Scratch, table, written

#: Neither stage nor the whole can be put in SQL: language models, XXH64 and BPE are not there. Tests hold them against plain versions.
ORACLE_SQL = None


def with_length(docs: DataFrame, columns: list[str], changed=None) -> DataFrame:
    """The given columns; n_chars again from the text, where it changed."""
    length = F.char_length("text").cast("long")
    if changed is not None:
        length = F.when(changed, length).otherwise(F.col("n_chars")) if "n_chars" in columns else length
    return docs.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, or with no likely language, go."""
    return langid.recognised(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"), least=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more: that with the least id."""
    return simhash.one_of_each(docs, simhash.similar_documents(docs, words=5, similarity=0.8))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has too."""
    return with_length(substrings.remove_repeats(docs, window=50), docs.columns, F.col("n_removed") > 0)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by the name of its kind."""
    return with_length(pii.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("language", keep_recognised),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each reads what the one before has written, which then goes.

    Null texts and such without a letter go with the first stage; a null id passes through all of them and is never a copy nor
    the original of one; rows that repeat an id and its text are copies of each other; an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-2]:
            before, docs = docs, scratch.written(stage(spark, docs, sf_dir), name)
            scratch.drop(before)
        docs = written(STAGES[-2][1](spark, docs, sf_dir), STAGES[-2][0])  # what is returned reads it until the application ends
    return STAGES[-1][1](spark, docs, sf_dir)
