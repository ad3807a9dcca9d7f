"""Text pieces of reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

def iso_text(moment: Column) -> Column:
    """``2024-02-01T00:00:00+00:00``, with the fraction only where there is one."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        F.pmod(F.unix_micros(moment), F.lit(1_000_000)) != 0, F.date_format(moment, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.concat(whole, fraction, F.lit("+00:00"))


def format_period(start: datetime | None, end: datetime | None) -> str:
    """``start to end``; an open start reads ``beginning``, an open end ``now``."""
    return f"{start.isoformat() if start else 'beginning'} to {end.isoformat() if end else 'now'}"


def json_map_text(entries: Column) -> Column:
    """A map with text keys and plain numbers as ``{"a": 1, "b": 2}``, in the map's order."""
    parts = F.transform(
        F.map_entries(entries),
        lambda entry: F.concat(F.lit('"'), entry["key"], F.lit('": '), entry["value"].cast("string")),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
