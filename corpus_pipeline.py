"""Training corpus pipeline: stages over documents, each written as Parquet and read by the next.

A stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of ``docs``; the
last returns the pieces of the packed sequences.  Filters keep every row they do not reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.llm import jaccard_join, langid, mixing, packing, toxicity
from vouchspark.llm.queries import CAPACITY, WORD_BPE
from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import fits_broadcast


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those that the calibrated model rejects."""
    judged = langid.predict(docs, langid.fit(docs))
    return judged.filter(~F.col("lang_rejected")).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose toxicity reaches the cut; labels of the rows still here teach the grammar."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.filter(F.col("toxicity") < toxicity.CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every component; rows with a NULL id stay."""
    dropped = stored(jaccard_join.jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if fits_broadcast(dropped) else dropped, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources come near their target sizes."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.packed_documents(docs, public_tokenizers.path(WORD_BPE), end_id=1, capacity=CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: Learned models, hashes and tokenisers are beyond SQL.  Tests compare the ids that the stages keep
#: on made rows; the mixture and the packing are compared with brute force apart, run() with nothing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
