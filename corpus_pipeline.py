"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

    language_id     documents without letters, or like no learned language, go
    line_dedup      lines of three or more documents stay only in the largest doc_id
    near_dedup      one document of each group of near copies stays, the smallest doc_id
    decontaminate   documents with a passage of the benchmark go
    packing         what is left becomes token sequences of at most 2048

All but the last return the columns of ``documents``. The first and the last stage have no SQL
form (a learned classifier, a tokenizer), so ``ORACLE_SQL`` is None and tests compare ``run`` with
a brute-force version.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import table
from lodeline.llm import language_id
from lodeline.llm.catalog import vocabulary
from lodeline.llm.common import with_columns_replaced
from lodeline.llm.decontaminate import remove_documents
from lodeline.llm.line_dedup import dedup_lines
from lodeline.llm.packing import pack_documents
from lodeline.llm.simhash import keep_one
from lodeline.session import ship, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    kept = language_id.predict(docs, model).where(~F.col("rejected"))
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs).drop("n_lines", "n_dropped")
    return with_columns_replaced(kept, n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


def _shipped(stage):
    """The stage, run after the package was sent to the workers, so that it can be called alone."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _shipped(keep_known_languages)),
    ("line_dedup", _shipped(drop_repeated_lines)),
    ("near_dedup", _shipped(drop_near_copies)),
    ("decontaminate", _shipped(drop_benchmark)),
    ("packing", _shipped(pack_sequences)),
]

ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
