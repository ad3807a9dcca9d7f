"""Frequencies, bins and calendar buckets as whole microseconds."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

# Frequency units of the request language and their microseconds.
UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "S": 1_000_000,
    "min": MINUTE_US,
    "T": MINUTE_US,
    "h": HOUR_US,
    "H": HOUR_US,
    "D": DAY_US,
}
# Buckets of the event aggregates.
BUCKETS = ("hour", "day")

_PART = re.compile(r"\s*(\d+(?:\.\d+)?)?\s*([A-Za-z]+)\s*")


def parse_frequency(text: str) -> int:
    """``15min``, ``1h``, ``1h30min``, ``1D`` ... as microseconds.

    Calendar units such as weeks or months have no fixed length and are refused.
    """
    total, position = Fraction(0), 0
    while position < len(text):
        part = _PART.match(text, position)
        if part is None or part.group(2) not in UNIT_US:
            raise ValueError(f"Invalid resample_frequency {text!r}; use for example 15min, 1h or 1D")
        total += Fraction(part.group(1) or 1) * UNIT_US[part.group(2)]
        position = part.end()
    if total <= 0 or total.denominator != 1:
        raise ValueError(f"Invalid resample_frequency {text!r}; it must be a positive duration")
    return int(total)


def as_utc(moment: datetime) -> datetime:
    """Attach UTC to a naive datetime, convert an aware one."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def timestamp_literal(moment: datetime) -> Column:
    """A timestamp constant that does not depend on the driver's local time zone."""
    return F.lit(as_utc(moment).isoformat()).cast("timestamp")


def micros(column: Column | str) -> Column:
    return F.unix_micros(column)


def floor_to_step(moment_us: Column, step_us: int, origin_us: Column | int = 0) -> Column:
    """The start of the step that holds ``moment_us``, counting steps from ``origin_us``."""
    origin = F.lit(origin_us) if isinstance(origin_us, int) else origin_us
    return moment_us - F.pmod(moment_us - origin, F.lit(step_us))


def divides_day(step_us: int) -> bool:
    return DAY_US % step_us == 0


def shared_grain(step_us: int) -> int:
    """The longest grain that both days and steps are whole multiples of."""
    return math.gcd(step_us, DAY_US)


def floor_to_bucket(moment: Column, bucket: str) -> Column:
    """The UTC hour or day a moment falls in."""
    if bucket not in BUCKETS:
        raise ValueError(f"buckets are {", ".join(BUCKETS)}, not {bucket!r}")
    return F.date_trunc(bucket, moment)
