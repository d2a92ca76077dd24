"""A corpus pipeline of five stages over documents; each stage reads what the one before it has written.

toxicity: documents that the conditional random field rejects go. near_duplicates: of documents whose five-word shingles
have a Jaccard similarity of 0.8 or more, directly or by steps, one stays. decontamination: documents that contain a test
item go. secrets: secrets in the texts are replaced. packing: what is left becomes token sequences.

All stages take null and empty texts, null and repeated ids, repeated rows, very long texts, empty tables and columns of any
other names; what each does with them is said below. But for the last, they return the columns that they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from satchel.llm import decontaminate, packing, secrets, simhash, toxicity
from satchel.llm.common import release, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, learnt from labelled documents of this very stage, takes for toxic.

    Null and empty texts are judged as texts of no words, and stay unless those are toxic; equal texts are judged alike.
    Without labelled documents nothing is toxic. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the least id, nulls last, ties by place.

    Null and empty texts, and those of white space alone, are one group. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a test item. Null and empty texts and items contain nothing; all copies of a
    document go or stay together; without items, or documents, nothing changes."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text where it changes. Null and empty texts
    stay as they are; an empty table stays empty."""
    return secrets.redact(docs, path_col="source", length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. A null or empty text is an end id alone, a null id stays
    null, repeated documents are packed as often as they occur, an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER), lot_bytes=1 << 20)  # beside what four stages have left


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages run trained models, an automaton and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each stage's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
