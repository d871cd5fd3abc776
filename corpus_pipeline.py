"""Corpus pipeline: filter, deduplicate, mix and pack the documents of a folder.

Each stage takes the documents its predecessor kept and is written as Parquet before the next one
reads it; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glintframe.llm.common import shared_folder
from glintframe.llm.jaccard import deduplicated
from glintframe.llm.mixing import mixed_documents
from glintframe.llm.packing import packed_documents
from glintframe.llm.quality import good_documents
from glintframe.llm.toxicity import clean_documents

STAGES = [
    ("toxicity", clean_documents),
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", deduplicated),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_documents),
]

#: The classifiers, MinHash and the packing plan have no SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
