"""The JSON contract that says which columns readings have and what makes a value valid."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS_TABLE = "sensor_readings"
NUMERIC_TYPES = frozenset({"float", "integer"})
_BUNDLED = Path(__file__).parent / "contracts" / "compressor_station.json"


class ContractError(ValueError):
    """The contract cannot be read, or the data does not have the columns it requires."""


@dataclass(frozen=True)
class ColumnRule:
    name: str
    data_type: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    unit: str | None = None
    flatline_minutes: int | None = None

    @property
    def is_numeric(self) -> bool:
        return self.data_type in NUMERIC_TYPES

    @property
    def has_range(self) -> bool:
        return self.low is not None and self.high is not None

    def out_of_range(self, value: Column) -> Column:
        """True where a value lies outside the inclusive range; null values are never outside."""
        if not self.has_range:
            return F.lit(False)
        return F.coalesce((value < F.lit(self.low)) | (value > F.lit(self.high)), F.lit(False))


@dataclass(frozen=True)
class Contract:
    version: str
    tables: dict[str, dict[str, ColumnRule]]

    def columns(self, table: str = READINGS_TABLE) -> dict[str, ColumnRule]:
        try:
            return self.tables[table]
        except KeyError:
            raise ContractError(f"the contract does not define {table}") from None

    def numeric(self, table: str = READINGS_TABLE) -> list[ColumnRule]:
        return [rule for rule in self.columns(table).values() if rule.is_numeric]

    def numeric_names(self, table: str = READINGS_TABLE) -> list[str]:
        return [rule.name for rule in self.numeric(table)]

    def required(self, table: str = READINGS_TABLE) -> list[str]:
        return [rule.name for rule in self.columns(table).values() if rule.required]

    def check_required_columns(self, frame: DataFrame, table: str = READINGS_TABLE) -> DataFrame:
        missing = sorted(set(self.required(table)) - set(frame.columns))
        if missing:
            raise ContractError(f"Missing required columns: {', '.join(missing)}")
        return frame

    def flatline_minutes(self, name: str, default: int) -> int:
        """The sensor's own threshold; unset and zero both fall back to the request's window."""
        return self.columns()[name].flatline_minutes or default

    def text_schema(self, table: str = READINGS_TABLE) -> T.StructType:
        """Every column as text, for file formats without types: coercion happens afterwards."""
        return T.StructType(
            [T.StructField(name, T.StringType()) for name in self.columns(table)]
        )

    def rules(self, spark: SparkSession, table: str = READINGS_TABLE) -> DataFrame:
        """The rules as a table of one row per column."""
        schema = (
            "column string, data_type string, required boolean, low double, high double, "
            "unit string, flatline_minutes int"
        )
        rows = [
            (r.name, r.data_type, r.required, r.low, r.high, r.unit, r.flatline_minutes)
            for r in self.columns(table).values()
        ]
        return spark.createDataFrame(rows, schema)


def load_contract(path: str | Path) -> Contract:
    """Read a contract document; any unreadable or incomplete document is a ``ContractError``."""
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise ContractError(f"cannot read the contract {path}") from error
    try:
        thresholds = {
            name: None if (minutes := entry.get("flatline_threshold_minutes")) is None else int(minutes)
            for name, entry in document.get("sensor_types", {}).items()
        }
        tables = {
            table: {
                name: _rule(name, entry, thresholds.get(name))
                for name, entry in body["columns"].items()
            }
            for table, body in document["tables"].items()
        }
        return Contract(version=str(document["version"]), tables=tables)
    except (AttributeError, KeyError, TypeError, ValueError) as error:
        raise ContractError("the contract lacks required fields") from error


def default_contract() -> Contract:
    return load_contract(_BUNDLED)


def _rule(name: str, entry: dict, flatline_minutes: int | None) -> ColumnRule:
    bounds = entry.get("valid_range")
    low, high = (float(bounds["min"]), float(bounds["max"])) if bounds else (None, None)
    return ColumnRule(
        name=name,
        data_type=str(entry["type"]),
        required=bool(entry.get("required", False)),
        low=low,
        high=high,
        unit=entry.get("unit"),
        flatline_minutes=flatline_minutes,
    )
