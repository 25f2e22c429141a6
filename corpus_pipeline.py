"""From documents to packed sequences: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of docs,
whatever their names, and no docs give no rows. Rows are numbered once, in a written table, so a null or repeated id and a
row that repeats another as a whole are rows of their own. `run` writes each stage's result to the shared folder and reads it
again, and frees it when the stage after it is written; what is left goes when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, exact_dedup, language_id, minhash, packing, simhash
from millrace.llm.common import without
from millrace.llm.queries import byte_bpe_ranks, with_crc
from millrace.sources.shared import new_path, numbered
from millrace.sources.store import Store

#: No stage before the packing can be expressed without trained models or XXH64.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is `und` (null, no letter), and the few whose words speak for all languages nearly alike.

    A text in a language that was never learned mostly passes: scores are shares among the learned ones. Repeated rows are judged alike.
    """
    return language_id.known_languages(docs, language_id.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, one stays: that of the smallest id, null ids last, of one id any one. Null and empty texts are equal."""
    docs, row = numbered(docs)
    return without(docs, row, exact_dedup.exact_groups(docs, row_col=row).where("not kept").withColumnRenamed("row", row))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays: that of the smallest id, null ids last, of one id the first row.

    Linked are documents that op9_simhash links and those with a Jaccard similarity of at least 0.8 over shingles of five words.
    Texts without words (null, empty, white space) have fingerprint zero and are linked to each other.
    """
    docs, row = numbered(docs)
    return without(docs, row, simhash.near_groups(docs, similarity=minhash.SIMILARITY, row_col=row).where("not kept").withColumnRenamed("row", row))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; a null or empty text has no words and stays, and without items all stay."""
    docs, row = numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, row, decontaminate.contamination(docs, benchmark, row_col=row).where("contaminated").withColumnRenamed("row", row))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their token ids; a null or empty text is the end id alone. Repeated rows are
    documents of their own."""
    return with_crc(packing.pack(docs, byte_bpe_ranks()))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", clean_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            Store(spark, before).delete("")
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
