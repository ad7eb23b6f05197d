"""Registration and the binding of the engine's tables to the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

G = 3600
DAY = 86400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def points(self) -> DataFrame:
        """``events`` as data points."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.read("events").select(
            "event_id",
            F.floor(us / 1_000_000).cast("bigint").alias("t"),
            us.alias("us"),
            "user_id",
            F.concat(F.lit("host"), F.col("user_id") % 10).alias("source"),
            F.concat(F.lit("zone"), F.col("user_id")).alias("zonename"),
            F.col("event_type").alias("optype"),
            F.col("value").alias("latency"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.lit(1.0).alias("value"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """One report per event; the instrumentation is the event type."""
        return self.points.select(
            F.col("optype").alias("inst_id"),
            "source",
            "t",
            F.col("event_id").alias("seq"),
            (F.col("t") - F.col("t") % G).alias("slot"),
            F.col("latency").alias("value"),
        )


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- SQL fragments ------------------------------------------------------------------

P = """p AS (
  SELECT event_id, epoch_us(ts) // 1000000 AS t, epoch_us(ts) AS us, user_id,
         'host' || (user_id % 10) AS source, 'zone' || user_id AS zonename,
         event_type AS optype, value AS latency,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(1 AS DOUBLE) AS value,
         (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % 3600 AS slot
  FROM events)"""


def with_p(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([P, *more]) + "\n" + body


def _num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def sql_log_linear(v: str, low: int = 0, base: int = 10, n: int = 100, top: int = 12, hi: bool = False) -> str:
    """Ladder over literal powers."""
    floor_value = float(base) ** low
    arms = [f"WHEN {v} < {_num(floor_value)} THEN {_num(floor_value if hi else 0)}"]
    for k in range(low, top + 1):
        order = float(base) ** k
        step = order * base / n
        lo = f"{_num(order)} + floor(({v} - {_num(order)}) / {_num(step)}) * {_num(step)}"
        out = f"{lo} + {_num(step)} - {_num(step / base)}" if hi else lo
        arms.append(f"WHEN {v} < {_num(float(base) ** (k + 1))} THEN {out}")
    return "CASE " + " ".join(arms) + " END"


def sql_event_log_linear(v: str, low: int, high: int, base: int = 10, n: int = 100, hi: bool = False) -> str:
    floor_value = float(base) ** low
    arms = [f"WHEN {v} < {_num(floor_value)} THEN {_num(floor_value - 1 if hi else 0)}"]
    for k in range(low, high + 1):
        order = float(base) ** k
        step = max(1.0, order * base / n)
        lo = f"{_num(order)} + floor(({v} - {_num(order)}) / {_num(step)}) * {_num(step)}"
        arms.append(f"WHEN {v} < {_num(float(base) ** (k + 1))} THEN {lo + f' + {_num(step)} - 1' if hi else lo}")
    over = 9223372036854775807.0 if hi else float(base) ** (high + 1)
    return "CASE " + " ".join(arms) + f" ELSE {_num(over)} END"


LL_LO = sql_log_linear("latency")
LL_HI = sql_log_linear("latency", hi=True)
