"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

Each stage takes (session, documents, folder of tables) and works on all rows
the one before kept. All but the last return the columns of documents, and any
others that ``docs`` has, whatever their names. Texts of any length are taken
whole; an empty table goes through every stage and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.llm import language, minhash, packing, substring
from gaitworks.llm.common import quoted, stored

#: Documents whose language is less sure than this go, and those without a letter.
LEAST_SCORE = 0.5
#: Documents are near copies from this similarity of their sets of shingles, in per cent. The contract of op7 has its own.
NEAR_PERCENT = 80


#: What the operators look at; the other columns ride along in one, so that no name of theirs meets a result's.
_SEEN, _REST = ("doc_id", "text"), "_rest"


def _narrow(docs: DataFrame) -> DataFrame:
    rest = [quoted(c) for c in docs.columns if c not in _SEEN]
    return docs.select(*_SEEN, *([F.struct(*rest).alias(_REST)] if rest else []))


def _widened(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns as they were, but for those that changed."""
    return found.select(*[(changed[c] if c in changed else F.col(c) if c in _SEEN else F.col(_REST)[c]).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; it learns from the labels that ``docs`` has itself.

    A null, empty or letterless text has no language and goes; a null ``lang`` is no label; repeated rows all stay.
    """
    found = language.identify(_narrow(docs), language.fit(docs))
    return _widened(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id (of equal ones, or without any, one row).

    Null texts and those without words are in no group and stay.
    """
    return _widened(minhash.representatives(_narrow(docs), percent=NEAR_PERCENT), docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that occur elsewhere; white space stays, ``n_chars`` follows the text.

    A null text stays null, with 0 characters; equal rows are each other's repeats.
    """
    found = substring.remove_repeated(_narrow(docs), joined_words=False)
    return _widened(found, docs.columns, text=F.col("kept"), n_chars=F.coalesce(F.char_length("kept"), F.lit(0)).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids (little-endian 32-bit values), sequence and offset.

    A null text counts as empty: its one piece is the end id. Repeated rows are packed each.
    """
    tokenized = packing.tokenize(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(packing.cut(tokenized))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Training, tokenizing and packing have no SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
