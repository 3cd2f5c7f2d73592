"""A corpus pipeline of five of the operators in `bookflow.llm`; every stage reads what the one before has written.

quality     documents that the base rules or the trees reject go
duplicates  of each group of near copies (five words, similarity 0.8) the document of smallest id stays
substrings  text that also stands earlier, in strings of 100 bytes or more, is cut out; a character cut in two goes whole
benchmark   documents that hold a test item go
tokens      every text becomes byte-level BPE ids, which are decoded again
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookflow.llm import bpe, decontam, jaccard, quality, queries, substrings

#: No SQL can express the trees, the token merges or the byte-wise cuts.
ORACLE_SQL = None


#: Rows of an Arrow batch that goes to a Python worker: whole texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return quality.filter_quality(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return jaccard.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return substrings.cut(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return decontam.drop_contaminated(docs, decontam.halves(queries.table(spark, sf_dir, "benchmark")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), round_trip: whether the ids decode to the text."""
    lean(spark)
    both = bpe.encode(docs.select("doc_id", "text"), queries.vocabulary("byte_bpe_50k.json"), back=True)
    return both.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", drop_poor), ("duplicates", drop_near_copies), ("substrings", cut_repeats), ("benchmark", drop_test_items), ("tokens", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = queries.folder(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
