"""Event-time windows that hold for bounded and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    """A stream needs a time zone and a watermark to close its windows; a bounded table needs neither."""
    if not df.isStreaming:
        return df
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, lateness or "0 seconds")


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], lateness: str | None = None) -> GroupedData:
    return _late(df, ts, lateness).groupBy(F.window(ts, width), *keys)


def sliding(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], lateness: str | None = None) -> GroupedData:
    return _late(df, ts, lateness).groupBy(F.window(ts, width, slide), *keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], lateness: str | None = None) -> GroupedData:
    return _late(df, ts, lateness).groupBy(F.session_window(ts, gap), *keys)
