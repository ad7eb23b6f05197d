"""Contiguous shards of near equal bytes, by global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
LAW = "bytes"


def prefix_sums(rows: DataFrame, order: list[str], slices: int, folder: str) -> DataFrame:
    """Adds ``before`` (bytes of all earlier rows) and ``index`` (their number) to rows with a ``size``.

    The rows are dealt into ordered slices once and written with their slice
    number to ``folder``, so that the slice totals and the rows that the totals
    are added to are the same, also when an executor is lost. Only the totals,
    one row a slice, meet in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows.repartitionByRange(slices, *keys).withColumn("slice", F.spark_partition_id()).write.parquet(folder)
    dealt = rows.sparkSession.read.parquet(folder)
    totals = dealt.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "slice",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
    )
    within = Window.partitionBy("slice").orderBy(*keys)
    sofar = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_own", F.coalesce(F.sum("size").over(sofar), F.lit(0)))
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, "slice")
        .withColumn("before", F.col("_bytes") + F.col("_own"))
        .withColumn("index", F.col("_n") + F.col("_row"))
        .drop("_bytes", "_own", "_n", "_row", "slice")
    )


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: where it goes when the table is cut into ``shards`` runs of near equal bytes.

    Documents stay in the order of their id. A document goes to the shard in
    whose equal share of all bytes its middle byte lies, so a shard is off its
    target by one document at most on either side. ``slot`` numbers the
    documents of a shard without gaps.

    A null text has no bytes; a null id comes first. Rows with the same id
    follow each other by size and checksum; fully equal rows are interchangeable,
    so their shards and slots form the same multiset whichever comes first.
    Empty tables give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    folder = new_dir(spark, "shards")
    placed = prefix_sums(rows, ["doc_id", "size", "text_crc32"], slices, folder)
    total = spark.read.parquet(folder).agg(F.sum("size")).first()[0] or 1
    # decimals: bytes times shards can pass the range of long
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(24,0)")
    share = F.floor(middle * F.lit(shards) / (F.lit(total).cast("decimal(24,0)") * 2)).cast("int")
    cut = placed.withColumn("shard", F.least(share, F.lit(shards - 1)))
    firsts = cut.groupBy("shard").agg(F.min("index").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
