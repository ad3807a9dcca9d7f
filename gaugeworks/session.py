"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "gaugeworks", **settings: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``settings`` use ``_`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Tables written down for a run go away with the DataFrames that read them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: text timestamps without an offset mean UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a missing setting is an
    error, since an executor could not read what another one wrote to its own disk.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="gaugeworks-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def write_down(frame: DataFrame) -> DataFrame:
    """Compute a table once into the shared folder; what follows starts from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def planned_ahead(spark: SparkSession) -> Iterator[None]:
    """Plan without run-time changes, so that a checkpoint remembers how its rows are laid out."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
