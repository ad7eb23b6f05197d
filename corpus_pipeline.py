"""Documents to training tokens: toxicity, quality, near-duplicates, decontamination, token ids.

Rows are what is kept or goes: a row without an id is judged like any other, and
rows that share an id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, jaccard, quality, toxicity
from tickloom.llm.queries import PATTERN, QUALITY_HELD_OUT, RANKS, TOXIC_HELD_OUT, held_out, read
from tickloom.sources.workdir import new_dir, written

#: Bytes of text that a task works on at once: whole documents pass through the stages.
PART = 1 << 20
ROW = "row_in_stage"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written, so that all that reads them sees the same numbers."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(TOXIC_HELD_OUT))
    scored = toxicity.score(docs, model, docs.columns, most=PART)
    return scored.filter("score < 0.5").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model rejects go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out(QUALITY_HELD_OUT))
    scored = quality.score(docs, model, docs.columns, most=PART)
    return scored.filter("score >= 0.5").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest id, of those with it one.

    Rows without an id come last. A row without words is no duplicate of any.
    """
    rows = numbered(docs)
    groups = jaccard.components(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = rows.select("doc_id", ROW).join(groups, ROW).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(f"first.{ROW}"), ROW, "left_semi").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words in benchmark windows go."""
    rows = numbered(docs)
    found = decontaminate.contamination(rows, read(spark, sf_dir, "benchmark"), id_col=ROW, most=PART)
    bad = found.filter("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts, with the digest of what they decode to."""
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), RANKS, PATTERN).drop("text")
    return bpe.with_digests(encoded, RANKS, PATTERN)


STAGES = [
    ("toxicity", clean),
    ("quality", good),
    ("ngram_jaccard", distinct),
    ("decontamination", uncontaminated),
    ("byte_bpe", tokens),
]

#: The trained models and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = new_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
