"""Stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns the columns of
documents; the last returns the pieces of the packed sequences. ``run`` writes every stage's result to the shared
folder and reads it back for the next. Null and repeated rows, empty texts and tables, and further columns are handled
as the operators' own texts say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermalframe.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from thermalframe.llm.store import table, written

#: SQL cannot express a fitted classifier or a tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


#: Rows of one Arrow batch between Spark and the stages' Python code; whole texts make large batches, held on both sides.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learnt from all labels, rejects."""
    _small_batches(spark)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs, model).where("__predicted = 1").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that a document of smaller id has; ``n_chars`` follows the text."""
    _small_batches(spark)
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def _known(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``: the id, or for a row without one a large number made of its text."""
    made = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return docs.withColumn("__id", F.coalesce("doc_id", made))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the smallest id.

    Rows with equal id and text are one document and stay once.
    """
    _small_batches(spark)
    known = _known(docs)
    ids = known.select(F.col("__id").alias("doc_id"), "text")
    groups = jaccard_join.jaccard_components(ids, size=5, percent=80)
    later = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    fate = later.withColumn("__copy", F.lit(0)).unionByName(
        groups.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__copy")).where("__copy > 1").join(later, "__id", "left_anti"))
    judged = known.join(written(fate, "fates"), "__id", "left")
    copies = Window.partitionBy("__id", F.sha2("text", 256)).orderBy(F.lit(0))
    several = judged.where("__copy > 1").withColumn("__copy", F.row_number().over(copies)).where("__copy = 1")
    return judged.where("__copy is null").unionByName(several).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    _small_batches(spark)
    known = _known(docs)
    found = decontaminate.contaminated(known.select(F.col("__id").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    held = found.select(F.col("doc_id").alias("__id")).distinct()
    return known.join(held, "__id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 2048.

    Other stages' memory is still held, and their chained steps leave more workers than tasks run at once: workers remember
    fewer words, and none of them between tasks.
    """
    _small_batches(spark)
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, cache=100_000, keep=False)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
