"""The corpus pipeline: five training-data stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factflow.llm import bpe, decontam, minhash, quality, suffix
from factflow.llm.queries import vocabulary_file
from factflow.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_rows(docs, field)


# 51 words of four letters with a space between them have 254 bytes.
ROW, NEAR_PERCENT, PASSAGE_BYTES = "__row", 80, 254


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of id and text, never null: rows that share an id but not a text, or have no id, stay apart."""
    return docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.80 or more) the document with the smallest id stays.

    Every row is judged on its own text. Rows without an id are linked with nothing and
    stay; of rows equal in id and text one stays.
    """
    keyed = _keyed(docs)
    named = keyed.where("doc_id IS NOT NULL").select(ROW, "doc_id").distinct()
    placed = minhash.near_duplicates(keyed.where("doc_id IS NOT NULL"), id_col=ROW, percent=NEAR_PERCENT).select(ROW, "component_id").distinct()
    kept = placed.join(named, ROW).groupBy("component_id").agg(F.min(F.struct("doc_id", ROW))[ROW].alias(ROW)).select(ROW)
    kept = kept.unionByName(keyed.where("doc_id IS NULL").select(ROW).distinct())
    first = F.row_number().over(Window.partitionBy(ROW).orderBy(ROW))
    return keyed.join(kept.hint("merge"), ROW, "left_semi").withColumn("__first", first).where("__first = 1").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of ``PASSAGE_BYTES`` or more go at all their places; characters cut in half go with them.

    op4's contract of 400 bytes binds its query alone: passages of little over 50 words are
    shorter than that.
    """
    return suffix.without_repeats(docs, window=PASSAGE_BYTES).withColumn("n_chars", F.char_length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged on its own text; a short item (see ``decontam``) is too little to reject a document."""
    keyed = _keyed(docs)
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).where("NOT short").select(ROW).distinct()
    return keyed.join(found.hint("merge"), ROW, "left_anti").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of the text decoded from them."""
    path = vocabulary_file("byte_bpe_50k.json")
    return bpe.digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), path).drop("text"), path))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
