"""The queries of the training-data problems 6 to 9; 7 to 9 run over the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import token_counts, token_ids
from gridloom.llm.langid import languages
from gridloom.llm.packing import packed
from gridloom.llm.percentile_queries import P6_SQL, p6_bounds, p6_percentiles

#: Capacity of a container in tokens.
CAPACITY = 4096


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return token_ids(_documents(spark, d), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one over the capacity, in tokens of byte_bpe_50k."""
    return packed(token_counts(_documents(spark, d), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language and confidence, and the same for each of its segments."""
    return languages(_documents(spark, d), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing or wrong, with their language, and the segments of documents in two or more languages."""
    found = p9_languages(spark, d)
    wrong = F.when(F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label_code")), F.array(F.struct(F.lit(0).cast("bigint").alias("from_line"), F.col("lang").alias("lang"))))
    parts = F.when(F.size(F.array_distinct("segments.lang")) > 1, F.transform("segments", lambda s: F.struct(s.from_line.alias("from_line"), s.lang.alias("lang"))))
    none = F.array().cast("array<struct<from_line:bigint,lang:string>>")
    return found.select("doc_id", F.inline(F.concat(F.coalesce(wrong, none), F.coalesce(parts, none)))).distinct()


def queries():
    return {"p6_percentiles": p6_percentiles, "p6_bounds": p6_bounds, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_languages": p9_languages}


def oracle_sql():
    return {"p6_percentiles": P6_SQL}
