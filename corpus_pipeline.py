"""From raw documents to packed training sequences: five stages, each a table in the shared folder that the next one reads.

Every stage works on all rows that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import common, decontamination, langid, line_dedup, minhash, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus teaches: those without a letter go, and those of which no machine is sure."""
    model, columns = langid.fit(docs), common.fresh(docs.columns, "lang_found", "lang_score")
    return langid.identify(docs, model, columns).where(~langid.is_rejected(model, "text", *columns)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the last document that has them; n_chars follows the text; documents left without a word go."""
    columns = _, n_dropped = common.fresh(docs.columns, "lines_before", "lines_dropped")
    out = line_dedup.drop_lines(docs, columns=columns)
    out = out.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id."""
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: Language identification, MinHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = common.written()
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"stage-{name}")
        common.tidy(before, docs)  # what the stage read and wrote for itself
    return STAGES[-1][1](spark, docs, sf_dir)
