"""H01-H16."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import heatmap as h
from tickloom.operators.aggregate import merge

from .aggregation import by_source_range, slots_both
from .base import G, LL_HI, LL_LO, query, with_p

N, TOP = 50, 200.0
CONF = h.Heatmap(0, TOP, N)
H = TOP / N

DIST = f"""dist AS (
  SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2, 3)"""


def cells_sql(source: str = "dist", series: str | None = None, ymax: str = f"{TOP}::DOUBLE", n: int = N, weight: str = "1") -> str:
    """Every range against every bucket, the plain way."""
    by = "slot" + (f", {series} AS series" if series else "")
    group = "slot, b" + (", series" if series else "")
    return f"""SELECT slot, b AS bucket{', series' if series else ''}, sum(share) AS value FROM (
  SELECT {by}, b, value * {weight} * (least(hi + 1, (b + 1) * w) - greatest(lo, b * w)) / (hi + 1 - lo) AS share
  FROM {source}, (SELECT unnest(range({n})) AS b), (SELECT {ymax} / {n} AS w)
  WHERE lo < (b + 1) * w AND hi + 1 > b * w) WHERE share > 0 GROUP BY {group}"""


def total(t):
    return merge(by_source_range(t), ["slot", "lo", "hi"])


def tidy(df):
    out = df.withColumn("value", F.round("value", 6))
    return out.withColumn("bucket", F.col("bucket").cast("bigint")) if "bucket" in df.columns else out


def rounded(sql: str, columns: str = "slot, bucket") -> str:
    return f"SELECT {columns}, round(value, 6) AS value FROM ({sql})"


@query("h01_grid", with_p(rounded(cells_sql()), DIST))
def h01(t):
    return tidy(h.grid(total(t), CONF))


@query("h02_auto_scale", with_p(rounded(cells_sql(ymax="(SELECT ceil(max(hi) * 1.02::DOUBLE) FROM dist)")), DIST))
def h02(t):
    return tidy(h.grid(total(t), h.Heatmap(0, None, N)))


@query("h03_weight_by_range", with_p(rounded(cells_sql(weight="(lo + hi) / 2")), DIST))
def h03(t):
    return tidy(h.grid(total(t), h.Heatmap(0, TOP, N, weights="weight")))


def series_grid(t, conf, pick=None):
    dist = pick(slots_both(t)) if pick else h.select_series(slots_both(t), conf)
    return tidy(h.grid(merge(dist, ["slot", "series", "lo", "hi"]), conf, ("slot", "series")))


SERIES = "slot, bucket, series"
PICKED = ("click", "purchase")
IN_PICKED = "key IN ('click', 'purchase')"


@query("h04_select_keys", with_p(rounded(
    cells_sql(series="'<total>'") + " UNION ALL " + cells_sql(f"(SELECT * FROM dist WHERE {IN_PICKED})", "key"), SERIES), DIST))
def h04(t):
    """The total grid and one per selected key."""
    return series_grid(t, CONF, lambda d: h.total_and_selected(d, PICKED))


@query("h05_deduct", with_p(rounded(cells_sql(series=f"CASE WHEN {IN_PICKED} THEN key ELSE '<total>' END"), SERIES), DIST))
def h05(t):
    return series_grid(t, h.Heatmap(0, TOP, N, selected=PICKED))


@query("h06_isolate", with_p(rounded(cells_sql(f"(SELECT * FROM dist WHERE {IN_PICKED})", "key"), SERIES), DIST))
def h06(t):
    return series_grid(t, h.Heatmap(0, TOP, N, selected=PICKED, isolate=True))


@query("h07_exclude", with_p(rounded(cells_sql(f"(SELECT * FROM dist WHERE NOT {IN_PICKED})", "'<total>'"), SERIES), DIST))
def h07(t):
    return series_grid(t, h.Heatmap(0, TOP, N, selected=PICKED, exclude=True))


@query("h08_decompose_all", with_p(rounded(cells_sql(series="key"), SERIES), DIST))
def h08(t):
    return series_grid(t, h.Heatmap(0, TOP, N, decompose_all=True))


@query("h09_hues", with_p("""
SELECT zonename AS series, CAST((21 + 91 * row_number() OVER (ORDER BY zonename)) % 360 AS INTEGER) AS hue
FROM (SELECT DISTINCT zonename FROM p)"""))
def h09(t):
    keys = t.points.select(F.col("zonename").alias("series"))
    return h.series_hues(keys, h.Heatmap(0, TOP, N, decompose_all=True))


NORMAL = "slot, bucket, round(value, 6) AS value, round(saturation, 6) AS saturation"


@query("h10_normalize_linear", with_p(f"SELECT {NORMAL} FROM (SELECT *, 0.9::DOUBLE * value / max(value) OVER () AS saturation FROM ({cells_sql()}))", DIST))
def h10(t):
    cells = h.normalize_linear(h.grid(total(t), CONF))
    return tidy(cells).withColumn("saturation", F.round("saturation", 6))


@query("h11_normalize_rank", with_p(f"""
SELECT {NORMAL} FROM (
  SELECT *, 0.9::DOUBLE * dense_rank() OVER (ORDER BY value) / (SELECT count(DISTINCT value) FROM cells) AS saturation FROM cells)""",
    DIST, f"cells AS (SELECT slot, bucket, round(value, 4) AS value FROM ({cells_sql()}))"))
def h11(t):
    """Values to four places, so that sums in another order are equal; they are ranked as they are."""
    cells = tidy(h.normalize_rank(h.grid(total(t), CONF).withColumn("value", F.round("value", 4))))
    return cells.withColumn("saturation", F.round("saturation", 6))


# Clicks on the image: every order is one, on a day-wide picture of 150 x 180.
CLICK = h.Heatmap(0, 100, 10, width=150, height=180)
DAY_SLOTS = 86400
CLICKS = """clicks AS (
  SELECT o_orderkey AS cell_id, 1704067200 + (o_custkey % 30) * 86400 AS start, o_orderkey % 150 AS x, o_custkey % 180 AS y FROM orders)"""
CELLS = """cells AS (
  SELECT cell_id, bt - bt % 3600 AS bucket_time, b * 10.0::DOUBLE AS bucket_ymin, (b + 1) * 10.0::DOUBLE AS bucket_ymax
  FROM (SELECT cell_id, start + x * 86400 // 150 AS bt, (179 - y) // 18 AS b FROM clicks))"""


def clicked(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    clicks = t.orders.select(
        o.alias("cell_id"), (F.lit(1704067200) + (c % 30) * 86400).alias("start"), (o % 150).alias("x"), (c % 180).alias("y")
    )
    at = h.cell_at(F.col("x"), F.col("y"), F.col("start"), DAY_SLOTS, CLICK, G)
    return clicks.select("cell_id", *(v.alias(n) for n, v in at.items()))


@query("h12_cell_lookup", "WITH " + CLICKS + "," + CELLS + "SELECT * FROM cells")
def h12(t):
    return clicked(t)


DETAILS = """details AS (
  SELECT cell_id, key, CAST(greatest(1, floor(sum(value * (least(hi + 1, bucket_ymax) - greatest(lo, bucket_ymin)) / (hi + 1 - lo)) + 0.5::DOUBLE)) AS BIGINT) AS value
  FROM cells JOIN dist ON slot = bucket_time WHERE lo < bucket_ymax AND hi + 1 > bucket_ymin GROUP BY 1, 2)"""


@query("h13_cell_details", with_p("SELECT * FROM details", DIST, CLICKS, CELLS, DETAILS))
def h13(t):
    return h.cell_details(slots_both(t), clicked(t))


@query("h13_cell_totals", with_p("""
SELECT cell_id, CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM cells LEFT JOIN details USING (cell_id) GROUP BY 1""",
    DIST, CLICKS, CELLS, DETAILS))
def h13_totals(t):
    cells = clicked(t)
    return h.detail_totals(h.cell_details(slots_both(t), cells), cells)


@query("h14_column_average", with_p(f"""
SELECT slot, round(sum(value * (bucket * {H} + {H} / 2)) / sum(value), 6) AS average FROM cells GROUP BY 1""",
    DIST, f"cells AS ({cells_sql()})"))
def h14(t):
    return h.column_average(total(t), CONF).withColumn("average", F.round("average", 6))


@query("h15_column_percentile", with_p(f"""
SELECT slot, round(min(bucket * {H} + (goal - (cum - value)) / value * {H}), 6) AS percentile
FROM (SELECT *, sum(value) OVER (PARTITION BY slot ORDER BY bucket) AS cum, 0.95::DOUBLE * sum(value) OVER (PARTITION BY slot) AS goal FROM cells)
WHERE cum >= goal AND cum - value < goal GROUP BY 1""", DIST, f"cells AS ({cells_sql()})"))
def h15(t):
    return h.column_percentile(total(t), CONF, 0.95).withColumn("percentile", F.round("percentile", 6))


@query("h16_limits", """
SELECT o_orderkey AS image_id, CASE WHEN width NOT BETWEEN 10 AND 1000 THEN 'width' WHEN height NOT BETWEEN 10 AND 1000 THEN 'height'
  WHEN nbuckets NOT BETWEEN 1 AND 100 THEN 'nbuckets' WHEN ymin NOT BETWEEN 0 AND 1e12::DOUBLE THEN 'ymin'
  WHEN ymax NOT BETWEEN 0 AND 1e12::DOUBLE THEN 'ymax' WHEN ymin >= ymax THEN 'scale' END AS error
FROM (
  SELECT o_orderkey, o_custkey % 1100 AS width, o_orderkey % 1050 AS height, o_orderkey % 107 AS nbuckets,
         CAST(o_custkey % 40 - 2 AS DOUBLE) AS ymin,
         CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN 1e13::DOUBLE ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS ymax
  FROM orders)""")
def h16(t):
    """Images asked for, one an order: which limit refuses them."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ymax = F.when(cust % 3 == 0, None).when(cust % 17 == 0, 1e13).otherwise((key % 90).cast("double"))
    error = h.settings_error(cust % 1100, key % 1050, key % 107, (cust % 40 - 2).cast("double"), ymax)
    return t.orders.select(key.alias("image_id"), error.alias("error"))


@query("h_image", with_p(f"""
SELECT c.slot, c.bucket, c.series, round(c.value, 6) AS value, round(0.9::DOUBLE * c.value / max(c.value) OVER (), 6) AS saturation,
       CAST(CASE c.series WHEN '<total>' THEN 21 WHEN 'click' THEN 112 ELSE 203 END AS INTEGER) AS hue
FROM ({cells_sql(series=f"CASE WHEN {IN_PICKED} THEN key ELSE '<total>' END")}) c""", DIST))
def h_image(t):
    """A drawn heatmap: grid, deduction, hues and linear colouring in one."""
    conf = h.Heatmap(0, TOP, N, selected=PICKED, coloring="linear")
    return tidy(h.image(slots_both(t), conf)).withColumn("saturation", F.round("saturation", 6)).select(
        "slot", "bucket", "series", "value", "saturation", "hue"
    )
