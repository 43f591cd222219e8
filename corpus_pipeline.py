"""A corpus pipeline: documents in, token ids of a clean, deduplicated, mixed corpus out.

Each stage takes what its predecessor kept, and all but the last return the columns of documents. Null texts count as empty, null ids
and repeated rows are rows like others, columns beyond those of documents pass through under whatever names, and an empty
table gives an empty one; texts of any length are read whole. What a stage does with each case is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.common import table, written
from tarnwork.llm.exact_dedup import kept_documents
from tarnwork.llm.jaccard import representatives
from tarnwork.llm.mixing import mixed_documents
from tarnwork.llm.pieces import encode_decode
from tarnwork.llm.quality import clean_documents

#: Weights of documents by their quality label; without a label 1.
GOOD, POOR = 2.0, 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts have too few words and go; each row is judged by itself."""
    return clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text: the smallest id, a null id last; of rows equal in id and text one."""
    return kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.75 or more of five-word shingles.

    The smallest id stays. Texts without words are linked with nothing and stay, as rows with a null id do.
    """
    return representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix of sources takes of a document.

    A null source is one of its own. Texts without words are left out. Rows equal in id and text are one document and get its copies
    each; ties of keys are settled by id. Without a label a document weighs 1.
    """
    w = F.max(F.when(F.col("quality") == 1, GOOD).otherwise(POOR))
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(w.alias("w"))
    return mixed_documents(docs, labels)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row; an empty text has the begin and end ids only."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mixing", mix), ("SentencePiece round trip", tokens)]

#: The stages of this pipeline that compress, hash keys and merge pieces have no SQL; tests/llm holds them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
