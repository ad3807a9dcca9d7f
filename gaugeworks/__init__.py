"""Fleet-scale sensor time-series analytics, written as Spark DataFrame jobs."""

from gaugeworks.config import MetricQuery, MetricThresholds, ProcessingOptions, StructuredQuery
from gaugeworks.contract import Contract, ContractError, default_contract, load_contract
from gaugeworks.session import build_session, prepare_session

__all__ = [
    "Contract",
    "ContractError",
    "MetricQuery",
    "MetricThresholds",
    "ProcessingOptions",
    "StructuredQuery",
    "build_session",
    "default_contract",
    "load_contract",
    "prepare_session",
]
