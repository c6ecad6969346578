"""From raw documents to packed training sequences: each stage is one of the operators, written and read again by the next.

Rows of documents (doc_id, text, lang, source, n_chars) go in, and come out of every stage but the last. What a stage
removes is gone for the next one; what it keeps is whole.

Defined cases: a null or empty text is never toxic on its own account, equals other empty texts, is in no near-duplicate
group, and is packed as a single end id; a null doc_id is a row like any other (smaller than any doc_id where the largest
stays, and the last to stay in a near-duplicate group); rows that share a doc_id, or have none, are judged by their own
texts all the way; of rows that repeat doc_id and text one stays; of ties between texts the largest doc_id stays in exact
dedup, the smallest in near-duplicate groups; very long texts are taken whole by every stage; nulls in other columns, more
columns, and columns named like those that operators use come along (`row`, `key`, `text_hash`, ...); tables without n_chars
do too; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import exact_dedup, jaccard, packing, substrings, toxicity
from framelake.llm.scratch import materialise

#: Words of a shingle, and the similarity (as a fraction) at which documents are near duplicates.
SHINGLE, SIMILARITY = 5, (8, 10)
#: Words of a window that may occur once.
WINDOW = 20
CAPACITY, END_ID = 1024, 2


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.CUT).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (a null is the largest, equals go by a hash of the text); of rows that repeat doc_id and text one."""
    return jaccard.survivors(docs, SHINGLE, *SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows that an earlier one has; where none goes, the text stays as it is."""
    out = substrings.dedup(docs, WINDOW, carry=docs.columns)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda df, stage: materialise(stage[1](spark, df, sf_dir), "stage"), STAGES, docs)
