"""Exact top-k inner products over vectors sorted by length.

Vectors are numbered by descending norm and dealt into blocks of bounded size, as are the queries. The longest vectors
are scored first, which gives every query a threshold: the k-th best of them. A later pair of blocks is dropped before
anything moves if no query of the one can reach its threshold with the longest vector of the other (Cauchy-Schwarz). Within
a pair of blocks, vectors are rotated by the right singular vectors of a sample, so that the first few coordinates
hold most of the length; partial sums of those plus the product of the residual lengths bound the full product. What may
still reach the threshold is scored exactly, on the whole numbers themselves. Every query meets every block or a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import write_down

SCALE = 64
QUERY_EVERY = 20
BLOCK = 2048
QUERY_BLOCK = 1024
SAMPLE = 4096
FIRST = 8


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 x) of each component x taken as double. Null keys and vectors that are null, empty or hold
    null or non-finite components take no part; a row that repeats another counts once."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return rows.select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v")).dropDuplicates(["vec_id", "v"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Add ``norm`` and ``block``: blocks of ``BLOCK`` rows of like norm, the longest first, wherever partitions end."""
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    ranged = rows.withColumn("norm", F.sqrt(square)).repartitionByRange(F.desc("norm"), F.col("vec_id"))
    placed = ranged.sortWithinPartitions(F.desc("norm"), F.col("vec_id")).withColumn("place", F.monotonically_increasing_id())
    # The upper bits of the place are the partition, the lower ones count within it.
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    written = write_down(placed.select("vec_id", "v", "norm", part.alias("part"), inside.alias("inside")))
    # One row per partition: the number of rows before it.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    block = F.floor((F.col("start") + F.col("inside")) / BLOCK)
    return written.join(F.broadcast(starts), "part").select("vec_id", "v", "norm", block.alias("block"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _meet(query_rows, vector_rows, basis: np.ndarray, k: int):
    """The best of one query block against one block of vectors: (query_id, vec_id, score) arrays.

    Queries carry the last of k others already found: ``least`` is its score, -inf if there are not that many, and
    ``last`` its id. Only what ranks before it is returned, so copies of a vector beyond the k first are not.
    """
    queries = np.array(query_rows["v"].tolist(), dtype=np.float64)
    vectors = np.array(vector_rows["v"].tolist(), dtype=np.float64)
    vec_ids, out = vector_rows["vec_id"].to_numpy(), []
    order = np.argsort(-vector_rows["norm"].to_numpy(), kind="stable")
    vectors, vec_ids = vectors[order], vec_ids[order]
    norms = vector_rows["norm"].to_numpy()[order]
    turned = vectors @ basis
    head = turned[:, :FIRST]
    rest = np.sqrt(np.maximum(norms**2 - (head**2).sum(axis=1), 0))
    carried = zip(*(query_rows[name] for name in ("query_id", "norm", "least", "last")))
    for query, (query_id, norm, least, last) in zip(queries, carried):
        # Room for rounding: bounds may be a little too high, never too low.
        room = 1e-9 * (1 + norm * (norms[0] if len(norms) else 0)) + 1e-6
        long = np.searchsorted(-(norm * norms), -(least - room), "right") if np.isfinite(least) else len(norms)
        if not long:
            continue
        turned_query = query @ basis
        query_head = turned_query[:FIRST]
        query_rest = np.sqrt(max(norm**2 - (query_head**2).sum(), 0))
        bound = head[:long] @ query_head + rest[:long] * query_rest
        alive = np.nonzero(bound >= least - room)[0]
        scores = vectors[alive] @ query  # whole numbers: exact below 2^53
        fit = ((scores > least) | (scores == least) & (vec_ids[alive] < last)) & (vec_ids[alive] != query_id)
        scores, ids = scores[fit], vec_ids[alive][fit]
        best = _best(scores, ids, k)
        out.append((np.full(len(best), query_id), ids[best], scores[best].astype(np.int64)))
    return [np.concatenate(part) if out else np.zeros(0, np.int64) for part in (zip(*out) if out else ([], [], []))]


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The k best per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, k: int = 20, query_every: int = QUERY_EVERY, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every`` the k best other rows.

    Scores are inner products of ``whole_numbers``; ties go to the smaller id; with fewer rows all are returned. Rows with
    the query's own id are not its candidates. Vectors must be of one length. An empty table gives an empty one. Columns
    other than the two named are not read.
    """
    spark = vectors.sparkSession
    rows = write_down(_blocks(whole_numbers(vectors, key, vector)))
    # Enough to turn the space well, whatever the number of rows; the result does not depend on it.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = np.linalg.svd(np.array([row["v"] for row in sample], dtype=np.float64), full_matrices=False)[2].T
    if basis.shape[1] < basis.shape[0]:
        basis = np.linalg.qr(np.hstack([basis, np.eye(basis.shape[0])]))[0]

    query_part = F.shiftright("place", 33) * (1 << 22) + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / QUERY_BLOCK)
    queries = write_down(
        rows.where(F.col("vec_id") % query_every == 0)
        .select(F.col("vec_id").alias("query_id"), "v", "norm")
        .coalesce(max(1, rows.rdd.getNumPartitions() // query_every))
        .withColumn("place", F.monotonically_increasing_id())
        .select("query_id", "v", "norm", query_part.alias("query_block"))
    )
    sizes = write_down(rows.groupBy("block").agg(F.count("*").alias("n"), F.max("norm").alias("longest")))
    # The longest block that has enough rows to give thresholds, its own query's row aside.
    start = sizes.orderBy((F.col("n") <= k).cast("int"), F.desc("longest"), "block").first()["block"]
    fields = "query_id long, vec_id long, score long"

    def pairs(blocks: DataFrame, asking: DataFrame) -> DataFrame:
        """All pairs of a query block and a block of vectors that may give something, met in a task each."""
        need = asking.groupBy("query_block").agg(F.max("norm").alias("reach"), F.min("least").alias("need"))
        room = 1e-9 * (1 + F.col("reach") * F.col("longest")) + 1e-6
        # Tables of one row per block: what is joined here are bounds, not vectors.
        met = write_down(
            blocks.join(F.broadcast(need), F.col("reach") * F.col("longest") >= F.col("need") - room).select("block", "query_block")
        )
        place = ["block", "query_block"]
        again = met.toDF(*place)
        asked = asking.join(met, "query_block").toDF("query_block", "query_id", "v", "norm", "least", "last", "block")
        offered = rows.join(again, "block").toDF("block", "vec_id", "v", "norm", "query_block")

        def run(queries_here, vectors_here):
            import pandas as pd

            if not len(queries_here) or not len(vectors_here):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _meet(queries_here, vectors_here, basis, k))))

        return asked.groupBy(*place).cogroup(offered.groupBy(*place)).applyInPandas(run, fields)

    unknown = queries.select("*", F.lit(float("-inf")).alias("least"), F.lit(0).cast("long").alias("last"))
    first = write_down(pairs(sizes.where(F.col("block") == start), unknown))
    worst = F.max(F.struct((-F.col("score")).alias("minus"), "vec_id")).alias("worst")
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), worst).where(F.col("n") >= k)
    score, last = -F.col("worst.minus").cast("double"), F.col("worst.vec_id")
    known = queries.join(least, "query_id", "left").select(
        "query_id",
        "v",
        "norm",
        "query_block",
        F.coalesce(score, F.lit(float("-inf"))).alias("least"),
        F.coalesce(last, F.lit(0).cast("long")).alias("last"),
    )
    later = pairs(sizes.where(F.col("block") != start), write_down(known))
    return _rank(first.union(later), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def oracle(k: int = 20, query_every: int = QUERY_EVERY) -> str:
    """The same in SQL."""
    return f"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % {query_every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= {k}"""
