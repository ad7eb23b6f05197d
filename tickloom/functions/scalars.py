"""Scalar helpers used by metric definitions and read-outs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: labels shown to users -----------------------------------
RUN_STATES = {
    "SRUN": "runnable",
    "SZOMB": "exited",
    "SSTOP": "stopped",
    "SIDL": "in proc creation",
    "SONPROC": "on-cpu",
    "SWAIT": "waiting to be runnable",
    "SSLEEP": "sleeping",
}
RUN_STATE_UNKNOWN = "unknown"
GC_TYPES = {1: "scavenge", 2: "mark and sweep"}
GC_TYPE_BOTH = "scavenge and mark and sweep."
TCP_ERRORS = {
    "attemptFails": "failed connection attempt",
    "retransSegs": "retransmitted segment",
    "inDupAck": "duplicate ACK",
    "listenDrop": "connection refused because backlog full",
    "listenDropQ0": "connection refused from full half-open queue",
    "halfOpenDrop": "connection dropped from a full half-open queue",
    "timRetransDrop": "connection dropped due to retransmit timeout",
}
UNIT_PREFIXES = {-9: "n", -6: "u", -3: "m", 0: "", 3: "K", 6: "M", 9: "G", 12: "T"}
# ---------------------------------------------------------------------------


def url_path(url: Column) -> Column:
    """URL without its query string."""
    return F.substring_index(url, "?", 1)


def request_origin(forwarded_for: Column, remote: Column) -> Column:
    """First forwarded address, or the peer when nothing was forwarded."""
    return F.when(F.length(forwarded_for) == 0, remote).otherwise(
        F.substring_index(forwarded_for, ",", 1)
    )


def query_prefix(query: Column, length: int = 6) -> Column:
    return F.concat(F.substring(query, 1, length), F.lit("..."))


def before_last_dash(probe: Column) -> Column:
    """``multi-update-done`` -> ``multi-update``."""
    return F.regexp_extract(probe, r"^(.*)-[^-]*$", 1)


def after_prefix(probe: Column, prefix: str) -> Column:
    """``server-search-done`` with prefix ``server-`` -> ``search``."""
    return F.substring_index(F.substr(probe, F.lit(len(prefix) + 1)), "-", 1)


def strip_prefix(probe: Column, prefix: str) -> Column:
    return F.regexp_replace(probe, f"^{prefix}", "")


def status_label(code: Column) -> Column:
    return F.when(code == 0, F.lit("success")).otherwise(F.lit("fail"))


def label(code: Column, labels: dict, default: str | None = None) -> Column:
    """Code to text with a ``CASE`` chain; the map is part of the definition."""
    out = None
    for k, text in labels.items():
        out = F.when(code == F.lit(k), F.lit(text)) if out is None else out.when(code == F.lit(k), F.lit(text))
    return out.otherwise(F.lit(default)) if default is not None else out


def rows_changed(probe: Column, changed: Column) -> Column:
    """Only updates report changed rows."""
    return F.when(probe.isin("update-done", "multi-update-done"), changed).otherwise(F.lit(0))


def decimal_id(n: Column) -> Column:
    return n.cast("string")


def hex_id(n: Column) -> Column:
    return F.lower(F.hex(n.cast("bigint")))


def unit_scale(value: Column, base: int | None, power: int | None, unit: str, abbr: str | None) -> Column:
    """``STRUCT<divisor, label>`` that brings ``value`` into a readable range.

    ``base`` 2 steps by 1024 and 10 by 1000.  The smallest prefix is taken
    under which the value stays below one step; the largest takes the rest.
    A type without base is shown as it is.
    """
    plain = F.struct(F.lit(1.0).alias("divisor"), F.lit(abbr or unit).alias("label"))
    if base is None:
        return plain
    step = 1024.0 if base == 2 else 1000.0
    first = power or 0
    if first not in UNIT_PREFIXES:
        return F.struct(F.lit(1.0).alias("divisor"), F.lit("").alias("label"))
    choices = [
        (step ** ((p - first) // 3), prefix + (abbr or unit)) for p, prefix in UNIT_PREFIXES.items() if p >= first
    ]
    out = None
    for divisor, text in choices[:-1]:
        cond = value / F.lit(divisor) < F.lit(step)
        item = F.struct(F.lit(divisor).alias("divisor"), F.lit(text).alias("label"))
        out = F.when(cond, item) if out is None else out.when(cond, item)
    divisor, text = choices[-1]
    return out.otherwise(F.struct(F.lit(divisor).alias("divisor"), F.lit(text).alias("label")))


def ceil2(value: Column) -> Column:
    """Round up to two decimals."""
    return F.ceil(value * 100) / F.lit(100.0)


def half_up(value: Column) -> Column:
    """Half rounds towards +infinity."""
    return F.floor(value + F.lit(0.5)).cast("bigint")
