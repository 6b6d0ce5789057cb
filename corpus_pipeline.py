"""Corpus pipeline: documents to token ids in five stages.

Each stage works on all rows its predecessor kept, is written as Parquet in the
shared folder, and is read back as the next stage's ``docs``. All stages but the
last return the columns of documents:

1. language ID: rejects texts without a recognised language (null, or no letter);
2. exact dedup: one document of each group of equal texts stays (largest id);
3. near dedup: one document of each near-duplicate component stays (smallest id);
4. mixing: each document is repeated 0, 1 or 2 times towards its source's target;
5. byte-level BPE: the token ids of every whole text.

Defined cases: an empty table gives no rows; a null text, or one without a
letter, goes in the first stage; a null id, language or source is kept as it is
(a null id is below all ids where one of equal texts stays; all null sources are
one source); repeated rows count as copies; rows with equal ids but different
texts are different documents to all stages but near dedup, which names a
component by its smallest id; extra columns go along and never clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup
from gavel.llm.common import id_crc, read_table
from gavel.llm.queries import BYTE_RANKS, split_pattern, vocabulary
from gavel.session import shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(id_crc("doc_id") % 4 != 2))
    return language_id.keep_known(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_column(docs, vocabulary(BYTE_RANKS), split_pattern())
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language inference, minhash and BPE have no SQL form; tests/llm compares
#: what each stage keeps with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = shared_path(spark, "llm", f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
