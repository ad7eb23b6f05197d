"""Values in messages: JSON text to long rows and back.

A message carries one value per source and time, in one of four shapes:
``12`` (scalar), ``{"a": 12}`` (keyed), ``[[[0, 9], 12], ...]`` (distribution)
and ``{"a": [[[0, 9], 12], ...]}`` (keyed distribution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALAR, KEYED, DISTRIBUTION, KEYED_DISTRIBUTION = "scalar", "keyed", "distribution", "keyed_distribution"
MESSAGE_SCHEMA = "inst_id string, source string, ts_ms double, seq bigint, value string"


def _ranges(text: Column) -> Column:
    """``ARRAY<STRUCT<lo, hi, value>>`` of a distribution's JSON."""
    pairs = F.from_json(text, "array<array<string>>")
    bounds = lambda p: F.from_json(p[0], "array<double>")
    return F.transform(
        pairs,
        lambda p: F.struct(
            bounds(p)[0].alias("lo"), bounds(p)[1].alias("hi"), p[1].try_cast("double").alias("value")
        ),
    )


def decode(messages: DataFrame, shape: str, column: str = "value") -> DataFrame:
    """Long rows of JSON values.

    A message without a value, or with an empty one, keeps one row with a NULL
    value, so that its source still counts as reporting.  What is no number is
    NULL; :func:`malformed` finds such messages.
    """
    rest = [c for c in messages.columns if c != column]
    text = F.col(column)
    if shape == SCALAR:
        return messages.select(*rest, text.try_cast("double").alias("value"))
    if shape == KEYED:
        parsed = F.from_json(text, "map<string, double>")
        return messages.select(*rest, F.explode_outer(parsed).alias("key", "value"))
    if shape == DISTRIBUTION:
        return messages.select(*rest, F.inline_outer(_ranges(text)))
    parsed = F.from_json(text, "map<string, string>")
    keyed = messages.select(*rest, F.explode_outer(parsed).alias("key", "__dist"))
    return keyed.select(*rest, "key", F.inline_outer(_ranges(F.col("__dist"))))


def malformed(messages: DataFrame, shape: str, column: str = "value") -> DataFrame:
    """Messages whose value is given but can't be read in this shape."""
    text = F.col(column)
    kinds = {SCALAR: None, KEYED: "map<string, double>", DISTRIBUTION: "array<array<string>>"}
    kind = kinds.get(shape, "map<string, string>")
    read = text.try_cast("double") if kind is None else F.from_json(text, kind)
    return messages.filter(text.isNotNull() & read.isNull())


def _number(c: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _ranges_json(dist: Column) -> Column:
    item = lambda e: F.concat(
        F.lit("[["), _number(e["lo"]), F.lit(","), _number(e["hi"]), F.lit("],"), _number(e["value"]), F.lit("]")
    )
    return F.concat(F.lit("["), F.array_join(F.transform(dist, item), ","), F.lit("]"))


def encode(packed: DataFrame, shape: str) -> DataFrame:
    """Packed values (``aggregate.pack``) as JSON text; NULL is the shape's zero."""
    v = F.col("value")
    zero = {SCALAR: "0", DISTRIBUTION: "[]"}.get(shape, "{}")
    if shape == SCALAR:
        text = _number(v)
    elif shape == DISTRIBUTION:
        text = _ranges_json(v)
    else:
        inner = _number if shape == KEYED else _ranges_json
        entries = F.transform(F.map_entries(v), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), inner(e["value"])))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    return packed.withColumn("value", F.coalesce(text, F.lit(zero)))


def _quoted(key: Column) -> Column:
    """A JSON string literal."""
    as_array = F.to_json(F.array(key))  # ["..."]
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)


def file_messages(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """Messages from JSON-lines files, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGE_SCHEMA).options(**options).json(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages from a Kafka topic (needs Spark's Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA).alias("m")).select("m.*")
