"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import write_down


#: Bytes of an Arrow batch. A batch lies in the executor and in its Python worker, with buffers up to twice as large.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets rows in Python in batches of some ``BATCH_BYTES`` at most, however long their texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def per_text(docs: DataFrame, key: str, text: str, schema: str, rows: Callable[[list, list], dict]) -> DataFrame:
    """Call ``rows(keys, texts as UTF-8 bytes or None)`` batch by batch and return its columns.

    Only the two columns named reach Python, so others may be called anything.
    """
    target = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = rows(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[field.name], type=field.type) for field in arrow], schema=arrow
                )

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


def components(links: DataFrame, vertex: str = "node") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node.

    ``links`` has columns a and b. Every round hangs each node below the smallest node that it or a
    neighbour hangs below and then shortens the way to the root, so the number of rounds grows with
    the logarithm of a component's length. Rounds end when nothing changes; each is written down.
    Null ends are left out; an empty table gives an empty one.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    both = write_down(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = write_down(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("c")))
    while True:
        # The smallest label around a node is offered to the node and to the root that it hangs below.
        around = (
            both.join(labels, both.b == labels.n)
            .groupBy("a")
            .agg(F.min("c").alias("m"))
            .join(labels, F.col("a") == labels.n)
            .select("n", F.col("c").alias("root"), F.least("c", "m").alias("m"))
        )
        offers = around.select("n", "m").union(around.select(F.col("root"), "m"))
        hung = offers.groupBy("n").agg(F.min("m").alias("c"))
        above = hung.select(F.col("n").alias("p"), F.col("c").alias("pc"))
        after = write_down(
            hung.join(above, hung.c == above.p, "left").select("n", F.least("c", F.coalesce("pc", "c")).alias("c"))
        )
        changed = after.join(labels.withColumnRenamed("c", "was"), "n").where("c <> was").limit(1).count()
        labels = after
        if not changed:
            return labels.select(F.col("n").alias(vertex), F.col("c").alias("component"))


def rows_with(docs: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with the only column of ``keys``, ``left_semi`` or ``left_anti``, whatever its columns are called."""
    name = "wanted"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    wanted = keys.toDF(name)
    return docs.join(wanted, docs[key] == wanted[name], how)


def unsigned_hex(value: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
