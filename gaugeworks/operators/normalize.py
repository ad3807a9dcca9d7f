"""Raw readings to typed readings, with one flag set per value for the quality counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.contract import Contract
from gaugeworks.functions.coerce import is_present, to_number, to_timestamp

STATION, DEVICE, TIME = "station_id", "device_id", "timestamp"
DEVICE_KEYS = (STATION, DEVICE)
# Per-reading flags: arrays of booleans in the order of the contract's numeric columns.
MALFORMED, OUT_OF_RANGE = "malformed", "out_of_range"


def normalize(frame: DataFrame, contract: Contract, *, nullify: bool = True) -> DataFrame:
    """Coerce every contract column, flag bad values and null those out of range.

    One projection does all of it, so it stays inside a single generated stage. Columns the contract
    does not know pass through; contract columns the data lacks are skipped, except that missing
    required columns are an error.
    """
    contract.check_required_columns(frame)
    types = {field.name: field.dataType for field in frame.schema.fields}
    rules = contract.columns()
    numeric = present_numeric(frame, contract)

    typed, malformed, outside = {}, [], []
    for name in numeric:
        raw = F.col(name)
        number = to_number(raw, types[name])
        beyond = rules[name].out_of_range(number)
        malformed.append(is_present(raw, types[name]) & number.isNull())
        outside.append(beyond)
        typed[name] = F.when(~beyond, number) if nullify else number

    columns: list[Column] = []
    for name in frame.columns:
        if name == TIME and types[name] != T.TimestampType():
            columns.append(to_timestamp(F.col(TIME), types[TIME]).alias(TIME))
        elif name in typed:
            columns.append(typed[name].alias(name))
        elif name in rules and name != TIME and types[name] != T.StringType():
            columns.append(F.col(name).cast("string").alias(name))
        else:
            columns.append(F.col(name))
    return frame.select(
        *columns, F.array(*malformed).alias(MALFORMED), F.array(*outside).alias(OUT_OF_RANGE)
    )


def present_numeric(frame: DataFrame, contract: Contract) -> list[str]:
    return [name for name in contract.numeric_names() if name in frame.columns]


def counted_columns(frame: DataFrame, contract: Contract) -> list[str]:
    """Contract columns the data has, time first, as the count maps list them."""
    return [TIME, *(n for n in contract.columns() if n != TIME and n in frame.columns)]


def station_counts(normalized: DataFrame, contract: Contract, finer: Sequence[str] = ()) -> DataFrame:
    """One row per station with every count the reports need, from one pass over the readings; ``finer`` names columns that
    a station's counts are parted by as well, for ``rolled_up`` to add up again.

    ``malformed_<column>``, ``out_of_range_<column>`` and ``missing_<column>`` are plain longs, so the
    aggregation combines on the map side and a station with most of the rows costs no more than others.
    """
    numeric = present_numeric(normalized, contract)
    readable = F.col(TIME).isNotNull()
    usable = readable & F.col(STATION).isNotNull() & F.col(DEVICE).isNotNull()
    complete = reduce(lambda left, right: left & right, [F.col(n).isNotNull() for n in numeric])
    counts = [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(readable).alias("readable_timestamps"),
        F.count_if(usable).alias("usable_rows"),
        F.count_if(usable & complete).alias("complete_rows"),
        F.count_if(~readable).alias(f"malformed_{TIME}"),
        F.count_if(~readable).alias(f"missing_{TIME}"),
    ]
    for position, name in enumerate(numeric):
        counts += [
            F.count_if(F.col(MALFORMED)[position]).alias(f"malformed_{name}"),
            F.count_if(F.col(OUT_OF_RANGE)[position]).alias(f"out_of_range_{name}"),
            F.count_if(F.col(name).isNull()).alias(f"missing_{name}"),
        ]
    return normalized.groupBy(STATION, *finer).agg(*counts)


def rolled_up(counts: DataFrame, finer: Sequence[str]) -> DataFrame:
    """Counts parted by ``finer`` as one row per station."""
    names = [name for name in counts.columns if name not in (STATION, *finer)]
    return counts.groupBy(STATION).agg(*[F.sum(name).alias(name) for name in names])


def malformed_counts(counts: DataFrame, names: list[str]) -> Column:
    """Malformed values per column as a map; text columns cannot be malformed and report 0."""
    return _count_map(counts, "malformed", names)


def out_of_range_counts(counts: DataFrame, names: list[str]) -> Column:
    """Out-of-range values per column as a map; time has no entry, text columns report 0."""
    return _count_map(counts, "out_of_range", [name for name in names if name != TIME])


def _count_map(counts: DataFrame, prefix: str, names: list[str]) -> Column:
    entries: list[Column] = []
    for name in names:
        known = f"{prefix}_{name}" in counts.columns
        entries += [F.lit(name), F.col(f"{prefix}_{name}") if known else F.lit(0).cast("bigint")]
    return F.create_map(*entries)


def sum_of(kind: str, contract: Contract) -> Column:
    """The sum over all columns of one kind of count; only ``malformed`` includes the time column."""
    names = [*([TIME] if kind == "malformed" else []), *contract.numeric_names()]
    return reduce(lambda left, right: left + right, [F.col(f"{kind}_{name}") for name in names])


def missing_percentages(names: list[str]) -> Column:
    """Share of missing values per column in percent, two decimals, half-even; no rows give 0."""
    entries: list[Column] = []
    for name in names:
        entries += [F.lit(name), missing_percentage(name)]
    return F.create_map(*entries)


def missing_percentage(name: str) -> Column:
    share = F.try_divide(F.col(f"missing_{name}").cast("double"), F.col("rows_read")) * 100.0
    return F.coalesce(F.bround(share, 2), F.lit(0.0))
