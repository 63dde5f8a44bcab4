"""Display timestamps as ``yyyy-MM-dd HH:mm:ss``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_ISO = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)(?:(?<=:\d{2}|\.\d{1,6})(?:Z|[+-]\d{2}:?\d{2}))?$"


def normalize_timestamp(text: Column, empty: Column | None = None) -> Column:
    """ISO date or date and time -> ``yyyy-MM-dd HH:mm:ss`` as on the wall
    clock (an offset or ``Z`` is dropped, not applied); text that is not one,
    such as a year or a time alone, is returned unchanged; null/empty gives
    ``empty`` (the "as of" time in views, '' in the CSV export)."""
    local = F.nullif(F.regexp_extract(text, _ISO, 1), F.lit(""))
    parsed = F.try_to_timestamp(local)
    out = F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), text)
    fallback = empty if empty is not None else F.lit("")
    return F.when(text.isNull() | (text == ""), fallback).otherwise(out)


def display_ts(ts: Column) -> Column:
    """A TIMESTAMP column rendered like S10's output."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
