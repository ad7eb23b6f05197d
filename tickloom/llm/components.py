"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs to one other at most, and that one to none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes with an edge but the roots; a root is the smallest node of its component.

    ``edges`` has the columns ``a`` and ``b``. Each round hangs every node's
    larger neighbours, then its smaller ones, to the smallest node around; the
    number of rounds grows with the logarithm of the longest path, and there is
    none for edges that are stars already. A node's
    neighbours are summed up by partial aggregation and never gathered. Each
    round is written to ``folder``, which cuts the lineage. Edges with a null end
    are left out.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    now = _written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    for number in range(1, most_rounds):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _written(large.unionByName(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u <> v")
                         .distinct(), f"{folder}/{number}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(),
                       f"{folder}/{number}-small")
    raise RuntimeError(f"no stars after {most_rounds} rounds")
