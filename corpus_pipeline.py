"""From raw documents to token ids: five stages, each an operator of the training-data subpackage.

Quality classifier (documents that it rejects go), line dedup, n-gram Jaccard join (one document of
each class stays), benchmark decontamination (documents that hold an item go), byte-level BPE.
Every stage but the last returns the columns of documents; the last returns the ids of each
document, checked by decoding. Between stages the documents are a table in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandset.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from strandset.llm._util import written

STAGES = [
    ("quality classifier", quality.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE", byte_bpe.stage),
]

# Boosted tables and patience alignment are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
