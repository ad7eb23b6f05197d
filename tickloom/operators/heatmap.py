"""Heatmap grids over distributions.

A grid has one column per slot and ``nbuckets`` equal buckets on
``[ymin, ymax)``.  A range ``[lo, hi]`` covers ``[lo, hi+1)`` and spreads its
count over the buckets in proportion to the overlap.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from ..sources.workdir import written
from .ranks import dense_ranks
from .slots import down

# --- fixed values: limits and colours -----------------------------------------
SIDE = (10, 1000)
BUCKETS = (1, 100)
MAX_VALUE = 1_000_000_000_000
FIRST_HUE, HUE_STEP = 21, 91
MAX_SATURATION = 0.9
HEADROOM = 1.02
# ------------------------------------------------------------------------------

TOTAL = "<total>"


@dataclass(frozen=True)
class Heatmap:
    ymin: float = 0
    ymax: float | None = None
    nbuckets: int = 100
    width: int = 600
    height: int = 300
    selected: Sequence[str] = field(default=())
    isolate: bool = False
    exclude: bool = False
    decompose_all: bool = False
    weights: str = "count"
    coloring: str = "rank"
    hues: Sequence[int] | None = None

    def __post_init__(self):
        for name, (low, high) in {"width": SIDE, "height": SIDE, "nbuckets": BUCKETS}.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f'"{name}" must be in {low}..{high}')
        for name in ("ymin", "ymax"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= MAX_VALUE:
                raise ValueError(f'"{name}" must be in 0..{MAX_VALUE}')
        if self.ymax is not None and self.ymin >= self.ymax:
            raise ValueError('"ymax" must be greater than "ymin"')
        if self.isolate + self.exclude + self.decompose_all > 1:
            raise ValueError('only one of "isolate", "exclude" and "decompose_all" may be given')
        if self.weights not in ("count", "weight") or self.coloring not in ("rank", "linear"):
            raise ValueError("unknown weights or coloring")
        if self.hues is not None:
            if any(not 0 <= h < 360 for h in self.hues):
                raise ValueError("invalid hue")
            needed = len(self.selected) + (0 if self.isolate else 1)
            if len(self.hues) < needed:
                raise ValueError(f"need {needed} hues")


def settings_error(width: Column, height: Column, nbuckets: Column, ymin: Column, ymax: Column) -> Column:
    """Which limit an image asked for row by row violates; NULL if none (``ymax`` may be NULL)."""
    outside = lambda c, low, high: ~c.between(low, high)
    return (
        F.when(outside(width, *SIDE), "width")
        .when(outside(height, *SIDE), "height")
        .when(outside(nbuckets, *BUCKETS), "nbuckets")
        .when(outside(ymin, 0, MAX_VALUE), "ymin")
        .when(outside(ymax, 0, MAX_VALUE), "ymax")
        .when(ymin >= ymax, "scale")
    )


def percentile_argument(p: float) -> float:
    if not 0 <= p <= 1:
        raise ValueError('"percentile" must be in 0..1')
    return p


def hues(nselected: int, isolate: bool = False) -> list[int]:
    """Colour of the background and of each series; isolation has no background."""
    out = [(FIRST_HUE + HUE_STEP * i) % 360 for i in range(nselected + 1)]
    return out[1:] if isolate else out


def hue_of(position: Column) -> Column:
    """Hue of series number ``position``; 0 is the background."""
    return (F.lit(FIRST_HUE) + position * F.lit(HUE_STEP)) % F.lit(360)


def auto_ymax(dist: DataFrame) -> DataFrame:
    """One row: upper end of the scale for the data held."""
    return dist.agg(F.ceil(F.max("hi") * F.lit(HEADROOM)).cast("double").alias("ymax"))


def _scale(dist: DataFrame, conf: Heatmap) -> Column:
    return F.lit(float(conf.ymax)) if conf.ymax is not None else auto_ymax(dist).scalar()


def grid(dist: DataFrame, conf: Heatmap, by: Sequence[str] = ("slot",)) -> DataFrame:
    """Cells ``by..., bucket, value`` of the non-empty buckets.

    ``dist`` should hold one row per ``by`` and range, i.e. be aggregated; each
    row makes at most ``nbuckets`` cells.
    """
    ymin, n = F.lit(float(conf.ymin)), conf.nbuckets
    rows = dist.select(*by, "lo", "hi", "value", _scale(dist, conf).alias("ymax"))
    rows = rows.withColumn("h", (F.col("ymax") - ymin) / F.lit(float(n)))
    rows = rows.filter((F.col("hi") + 1 > ymin) & (F.col("lo") < F.col("ymax")) & (F.col("value") != 0))
    first = F.greatest(F.floor((F.col("lo") - ymin) / F.col("h")), F.lit(0))
    last = F.least(F.ceil((F.col("hi") + 1 - ymin) / F.col("h")) - 1, F.lit(n - 1))
    # Rounding of the division may name a neighbour without overlap; the
    # positive-overlap filter drops it.
    cells = rows.withColumn("bucket", F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))))
    low = ymin + F.col("bucket") * F.col("h")
    overlap = F.least(F.col("hi") + 1, low + F.col("h")) - F.greatest(F.col("lo"), low)
    share = F.col("value") * overlap / (F.col("hi") + 1 - F.col("lo"))
    if conf.weights == "weight":
        share = share * (F.col("lo") + F.col("hi")) / 2
    return (
        cells.withColumn("share", F.when(overlap > 0, share))
        .filter(F.col("share").isNotNull())
        .groupBy(*by, "bucket")
        .agg(F.sum("share").alias("value"))
    )


def select_series(dist: DataFrame, conf: Heatmap) -> DataFrame:
    """Name the series each keyed row belongs to.

    Every row lands in one series: a selected key, or the background (total
    minus the selected keys).  ``isolate`` keeps the selected ones, ``exclude``
    the background and ``decompose_all`` selects every key.
    """
    if conf.decompose_all:
        return dist.withColumn("series", F.col("key"))
    chosen = F.col("key").isin(list(conf.selected)) if conf.selected else F.lit(False)
    if conf.isolate:
        return dist.filter(chosen).withColumn("series", F.col("key"))
    if conf.exclude:
        return dist.filter(~chosen).withColumn("series", F.lit(TOTAL))
    return dist.withColumn("series", F.when(chosen, F.col("key")).otherwise(F.lit(TOTAL)))


def total_and_selected(dist: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The full total next to each selected key (before anything is deducted)."""
    names = F.when(F.col("key").isin(list(selected)), F.array(F.lit(TOTAL), F.col("key"))).otherwise(
        F.array(F.lit(TOTAL))
    )
    return dist.withColumn("series", F.explode(names))


def series_hues(cells: DataFrame, conf: Heatmap) -> DataFrame:
    """``(series, hue)`` of the series shown: background first, then keys in
    the order given, or by name when all are decomposed."""
    if conf.decompose_all:
        ranked, _ = dense_ranks(cells, F.col("series"), "series")
        return ranked.select("series", hue_of(F.col("rank")).cast("int").alias("hue"))
    chosen = list(conf.hues) if conf.hues is not None else hues(len(conf.selected), conf.isolate)
    names = list(conf.selected) if conf.isolate else [TOTAL, *conf.selected]
    if not names:  # an isolated image without selection is empty
        return cells.select("series").distinct().withColumn("hue", F.lit(0))
    table = F.create_map(*(F.lit(v) for pair in zip(names, chosen) for v in pair))
    return cells.select("series").distinct().withColumn("hue", table[F.col("series")])


def image(dist: DataFrame, conf: Heatmap) -> DataFrame:
    """Cells of a keyed heatmap with hue and saturation, ready to be drawn."""
    from .aggregate import merge

    series = merge(select_series(dist, conf), ["slot", "series", "lo", "hi"])
    cells = normalize(written(grid(series, conf, ("slot", "series")), "image"), conf.coloring)
    return cells.join(series_hues(cells, conf), "series")


def normalize(cells: DataFrame, coloring: str = "rank") -> DataFrame:
    return normalize_linear(cells) if coloring == "linear" else normalize_rank(cells)


def normalize_linear(cells: DataFrame) -> DataFrame:
    """Saturation in proportion to the largest cell."""
    top = cells.agg(F.max("value").alias("m")).scalar()
    return cells.withColumn("saturation", F.lit(MAX_SATURATION) * F.col("value") / top)


def normalize_rank(cells: DataFrame) -> DataFrame:
    """Saturation by rank among the distinct non-zero cell values."""
    cells = written(cells, "cells")
    level = F.when(F.col("value") > 0, F.col("value"))
    ranked, count = dense_ranks(cells, level)
    share = F.lit(MAX_SATURATION) * F.col("rank") / max(count, 1)
    return cells.withColumn("level", level).join(ranked, "level", "left").select(
        *cells.columns, F.coalesce(share, F.lit(0.0)).alias("saturation")
    )


# --- cell details -------------------------------------------------------------


def cell_at(x: Column, y: Column, start: Column, duration: int, conf: Heatmap, g: int) -> dict[str, Column]:
    """Time slot and value range under a pixel; the origin is at the top left."""
    if conf.ymax is None:
        raise ValueError('"ymax" must be specified')
    bucket_height = conf.height / conf.nbuckets
    column = F.floor(x * F.lit(duration) / F.lit(conf.width))
    bucket = F.floor((F.lit(conf.height - 1) - y) / F.lit(bucket_height))
    h = (conf.ymax - conf.ymin) / conf.nbuckets
    return {
        "bucket_time": down((start + column).cast("bigint"), g),
        "bucket_ymin": F.lit(float(conf.ymin)) + bucket * F.lit(h),
        "bucket_ymax": F.lit(float(conf.ymin)) + (bucket + 1) * F.lit(h),
    }


def check_pixel(x: int, y: int, conf: Heatmap) -> None:
    if conf.ymax is None:
        raise ValueError('"ymax" must be specified')
    if not 0 <= x < conf.width:
        raise ValueError('"x" must be less than "width"')
    if not 0 <= y < conf.height:
        raise ValueError('"y" must be less than "height"')


def cell_details(dist: DataFrame, cells: DataFrame, by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Whole-number contribution of each key to each cell.

    ``cells`` holds ``by..., bucket_time, bucket_ymin, bucket_ymax``; equal
    cells are looked up once.  Non-zero shares count at least 1.  Without keys
    there is one row per cell, and the total of a cell is the sum of its rows.
    """
    keyed = ["key"] if "key" in dist.columns else []
    place = ["bucket_time", "bucket_ymin", "bucket_ymax"]
    hit = dist.withColumnRenamed("slot", "bucket_time").join(cells.select(*place).distinct(), "bucket_time")
    overlap = F.least(F.col("hi") + 1, F.col("bucket_ymax")) - F.greatest(F.col("lo"), F.col("bucket_ymin"))
    share = F.when(overlap > 0, F.col("value") * overlap / (F.col("hi") + 1 - F.col("lo"))).otherwise(0.0)
    found = (
        hit.groupBy(*place, *keyed)
        .agg(F.sum(share).alias("share"))
        .filter(F.col("share") != 0)
        .select(*place, *keyed, F.greatest(F.lit(1).cast("bigint"), half_up(F.col("share"))).alias("value"))
    )
    return cells.join(found, place).select(*by, *keyed, "value")


def detail_totals(details: DataFrame, cells: DataFrame, by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Total per cell, 0 where nothing was found."""
    sums = details.groupBy(*by).agg(F.sum("value").alias("total"))
    return cells.select(*by).join(sums, list(by), "left").select(*by, F.coalesce("total", F.lit(0)).alias("total"))


# --- column statistics ----------------------------------------------------------


def _edges(conf: Heatmap, dist: DataFrame) -> tuple[Column, Column]:
    """Bucket height and lower edge of ``bucket``."""
    h = (_scale(dist, conf) - F.lit(float(conf.ymin))) / F.lit(float(conf.nbuckets))
    return h, F.lit(float(conf.ymin)) + F.col("bucket") * h


def column_average(dist: DataFrame, conf: Heatmap) -> DataFrame:
    """Mean per column, each cell at the middle of its bucket."""
    h, low = _edges(conf, dist)
    cells = grid(dist, conf).withColumn("mid", low + h / 2)
    return cells.groupBy("slot").agg((F.sum(F.col("value") * F.col("mid")) / F.sum("value")).alias("average"))


def column_percentile(dist: DataFrame, conf: Heatmap, p: float) -> DataFrame:
    """Value under which a share ``p`` of a column lies, linear inside a bucket."""
    p = percentile_argument(p)
    h, low = _edges(conf, dist)
    cells = grid(dist, conf).select("slot", "bucket", "value", low.alias("low"), h.alias("h"))
    w = Window.partitionBy("slot")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumns(
        {"cum": F.sum("value").over(upto), "goal": F.lit(float(p)) * F.sum("value").over(w),
         "top": F.max("bucket").over(w)}
    )
    # The last bucket catches a cumulative sum that rounding left under the goal.
    hit = ranked.filter(
        ((F.col("cum") >= F.col("goal")) & (F.col("cum") - F.col("value") < F.col("goal")))
        | ((F.col("bucket") == F.col("top")) & (F.col("cum") < F.col("goal")))
    ) if p > 0 else ranked.filter(F.col("bucket") == F.col("top"))
    part = F.least((F.col("goal") - (F.col("cum") - F.col("value"))) / F.col("value"), F.lit(1.0))
    y = F.col("low") + part * F.col("h") if p > 0 else F.lit(0.0)
    return hit.select("slot", y.alias("percentile"))
