"""A cleaning pipeline for text corpora: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.tables import remove, shared_folder, table
from geoflow.llm import decontaminate, language, lines, neardup, packing
from geoflow.llm.queries import CONTEXT, SITES, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that resemble none of the languages."""
    return language.spoken_rows(docs, language.train(docs, F.lit(True)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that occur on many sources; all documents stay."""
    return lines.without_boilerplate(docs, SITES)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate group."""
    return neardup.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of test items; documents that are mostly such passages go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    pieces = packing.cut_into_pieces(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), CONTEXT)
    return packing.pack(pieces, CONTEXT, ["doc_id", "piece"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("packing", pack_documents),
]
#: Language models, MinHash and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each stage's result is written as Parquet, read again and removed after the next one."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the stage has read is needed no more
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
