"""A training corpus from documents: toxic ones go, repeated lines go, near copies go, sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with extra
columns of any name. Empty tables stay empty. Rows with a null doc_id and null or empty texts pass all stages but toxicity's
verdict on their text (an empty text scores 0 and stays); rows that repeat a doc_id share their stage's decision on that id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import bpe_encode
from tidewatch.llm.common import cut, table
from tidewatch.llm.jaccard import keep_one
from tidewatch.llm.lines import dedup_lines
from tidewatch.llm.mixing import draw, mix_rates
from tidewatch.llm.queries import WORD_BPE
from tidewatch.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go; null and empty texts stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and documents of which they leave nothing; n_chars follows the text.

    Null texts and rows without a doc_id stay as they are.
    """
    out = dedup_lines(docs).where("n_removed < n_lines OR n_lines = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity of 0.8, the one with the smallest doc_id stays.

    Empty texts and rows without a doc_id stay; so do all rows that carry the kept doc_id.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is drawn as often as its rate asks: not at all, once, or more than once; without words or a doc_id once."""
    return draw(docs, mix_rates(docs, table(spark, sf_dir, "labels")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every row; null and empty texts have no tokens."""
    return bpe_encode(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mixing", mixing), ("encoding", encoding)]

#: The toxicity network and the fitted rates are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
