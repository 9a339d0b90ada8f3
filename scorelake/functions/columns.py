"""Scalar rules used across reports: defaults, ratios, units, labels, timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes per float32 value, and the two megabyte conventions
# (storage figures are decimal, device memory is binary).
FLOAT_BYTES = 4
MB_DECIMAL = 1_000_000
MB_BINARY = 1024 * 1024


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_tag(signals, images, detections, partitions, mode=None, ts=None, run_name=None) -> Column:
    """``sig{}_img{}_det{}_p{}``, with run name, mode and time added where given."""
    tag = F.format_string("sig%d_img%d_det%d_p%d", *map(_col, (signals, images, detections, partitions)))
    name = F.nullif(_col(run_name), F.lit("")) if run_name is not None else None
    parts = [name, None if mode is None else _col(mode), tag, None if ts is None else _col(ts)]
    return F.concat_ws("_", *[p for p in parts if p is not None])


def run_file_name(prefix: str, mode, samples, ts) -> Column:
    """File name of a run record: prefix, mode, sample count and compact time."""
    stamp = F.date_format(_col(ts), "yyyyMMdd_HHmmss")
    return F.concat(F.concat_ws("_", F.lit(prefix), _col(mode), _col(samples).cast("string"), stamp), F.lit(".json"))


def thousands(c) -> Column:
    """Report format of a number: no decimals, comma separated."""
    return F.format_number(_col(c), 0)


def host_of(c) -> Column:
    """Host part of ``host:port``; ``unknown`` when missing or empty."""
    present = F.nullif(_col(c), F.lit(""))
    return F.substring_index(F.coalesce(present, F.lit("unknown")), ":", 1)


def short_label(host, device=None, n: int = 20) -> Column:
    """Host cut to ``n`` characters, with the device in brackets where given."""
    head = F.substring(_col(host), 1, n)
    return head if device is None else F.concat(head, F.lit(" ("), _col(device), F.lit(")"))


def parse_time(c) -> Column:
    """ISO text, or the status form ending in a zone name, to a timestamp."""
    text = _col(c)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSz")),
        text.try_cast("timestamp"),
    )


def duration_s(start, end) -> Column:
    """Seconds between two timestamps, exact to the microsecond."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def mb(c, binary: bool = False) -> Column:
    return _col(c) / F.lit(float(MB_BINARY if binary else MB_DECIMAL))


def ms_to_s(c) -> Column:
    return _col(c) / F.lit(1000.0)


def safe_ratio(x, t) -> Column:
    """``x / t``, and 0 where ``t`` is not above 0 or is missing."""
    return F.coalesce(F.when(_col(t) > 0, _col(x) / _col(t)), F.lit(0.0))


def round_s(c) -> Column:
    """Rounded by the shortest decimal text of the value, ties away from zero: 2.675
    to two digits is 2.68. Rounding its binary value would give 2.67, so on such
    ties, and only there, the last digit may differ by one from other tools."""
    return F.round(_col(c), 4)


def round_tp(c) -> Column:
    return F.round(_col(c), 1)


def round_ms(c) -> Column:
    return F.round(_col(c), 2)


def payload_bytes(c) -> Column:
    """Bytes of a float vector; a missing vector has none."""
    return F.coalesce(F.size(_col(c)), F.lit(0)).cast("long") * FLOAT_BYTES


def payload_mb(df: DataFrame, col: str, partitions: int = 1) -> DataFrame:
    """Rows, total MB and MB per partition of a vector column."""
    total = F.sum(F.when(F.col(col).isNotNull(), payload_bytes(col)).otherwise(F.lit(0)))
    return df.agg(F.count(F.lit(1)).alias("rows"), mb(total).alias("total_mb")).withColumn(
        "mb_per_partition", F.col("total_mb") / F.lit(float(partitions))
    )


def map_get(c, key: str, default=0) -> Column:
    """Value of ``key``; the default when the key, or the whole map, is absent."""
    return F.coalesce(F.try_element_at(_col(c), F.lit(key)), F.lit(default))


def merge_dims(*maps) -> Column:
    """Merge dimension maps left to right; on an equal key the later map wins.

    Earlier entries whose key appears later are filtered out first, so the
    result does not depend on the session's duplicate-key setting.
    """

    def present(m):
        return F.coalesce(_col(m), F.create_map().cast("map<string,string>"))

    def merge(earlier, later):
        return F.map_concat(F.map_filter(earlier, lambda k, _v: ~F.map_contains_key(later, k)), later)

    return reduce(merge, map(present, maps))


def prop(c, path: str, kind: str = "string") -> Column:
    """One property of a JSON text; null when absent or of another type."""
    return F.get_json_object(_col(c), path).try_cast(kind)
