"""Ids accepted so far, in sets of files with membership filters, so that a batch opens only files that may hold its ids.

A set holds the ids of one batch, or of the batches that a fold has put together. It is parted into pieces by a hash of the id, as
many as its size asks for: twice as many whenever it doubles. A task writes one piece, or filters for ``FILTER_IDS`` ids. Each piece has a blocked Bloom filter: the hash names a block of
``BLOCK_BITS`` bits, three more parts of it the bits there. Filters lie beside the sets, a row per block, in order of pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import write_down

PIECE = "piece"
#: Ids in a piece, at most twice as many; pieces are the files that a look-up opens.
PIECE_IDS = 1_000_000
#: Bits of a filter block, as many as Spark's bitmaps have.
BLOCK_BITS = 1 << 15
BITS_PER_ID = 16
#: Ids whose filter blocks one task puts together.
FILTER_IDS = 250_000
#: Up to this many ids of one batch are sent to every task that scans filters or accepted ids; ids count once per shape of a set.
BROADCAST_IDS = 1_000_000
#: Up to this many pieces are opened one by one; more are read as whole sets.
NAMED_PIECES = 10_000


@dataclass(frozen=True)
class IdSet:
    """Where a set and its filters lie, and how it is parted."""

    name: str
    ids: str
    filters: str
    rows: int
    pieces: int
    blocks: int


def shape(rows: int, piece_ids: int = PIECE_IDS) -> tuple[int, int]:
    """(pieces, blocks of a piece's filter) of a set, both powers of two."""

    def parts(number: float) -> int:
        return 1 << max(0, math.ceil(math.log2(number))) if number > 0 else 1

    pieces = parts(rows / piece_ids)
    return pieces, parts(rows / pieces * BITS_PER_ID / BLOCK_BITS)


def _piece(pieces) -> Column:
    return F.xxhash64("event_id").bitwiseAND(pieces - 1)


def _block(blocks) -> Column:
    return F.shiftrightunsigned(F.xxhash64("event_id"), 32).bitwiseAND(blocks - 1)


def _bits() -> Column:
    """The places of an id in its block."""
    other = F.xxhash64(F.lit("bits"), F.col("event_id"))
    return F.array(*[F.shiftrightunsigned(other, shift).bitwiseAND(F.lit(BLOCK_BITS - 1)) for shift in (0, 15, 30)])


def write_ids(frame: DataFrame, name: str, ids: str, filters: str, rows: int, piece_ids: int = PIECE_IDS) -> IdSet:
    """Write a set; ``frame`` has ``rows`` rows with a column event_id and is read twice, so it should be stored."""
    pieces, blocks = shape(rows, piece_ids)
    parted = frame.withColumn(PIECE, _piece(F.lit(pieces)))
    # By number and not by hash, which would put several pieces into one task.
    laid = parted.repartitionById(pieces, F.col(PIECE).cast("int")) if pieces > 1 else parted.coalesce(1)
    laid.write.mode("overwrite").partitionBy(PIECE).parquet(ids)
    # Ids are laid out by block first, so a block's bitmap is made in one task and none travels.
    placed = frame.select(_piece(F.lit(pieces)).alias(PIECE), _block(F.lit(blocks)).alias("block"), _bits().alias("places"))
    placed = placed.repartitionByRange(max(1, math.ceil(rows / FILTER_IDS)), PIECE, "block")
    marked = placed.select(PIECE, "block", F.explode("places").alias("bit"))
    # Bitmap positions count from 0 within a block.
    made = marked.groupBy(PIECE, "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    made = made.select(F.lit(name).alias("set"), PIECE, "block", "bits")
    made.sortWithinPartitions(PIECE, "block").write.mode("overwrite").parquet(filters)
    return IdSet(name, ids, filters, rows, pieces, blocks)


def _holds(place: str) -> str:
    """SQL: whether the bit at a place of the block is set. Bitmaps count bits from the lowest of each byte."""
    byte = f"cast(conv(hex(substring(bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    return f"shiftright({byte}, cast({place} % 8 as int)) & 1 = 1"


def may_hold(spark: SparkSession, ids: DataFrame, count: int, sets: list[IdSet]) -> DataFrame:
    """(set, piece, event_id): the pieces that may hold each of the ``count`` ids; some per mille of them do not.

    Sets of one shape look for an id in the same place, so ids are laid out once per shape and not per set. Only they are
    kept in memory; filters, which grow with all that was ever accepted, pass by.
    """
    shapes = sorted({(s.pieces, s.blocks) for s in sets})
    forms = F.array(*[F.struct(F.lit(pieces).cast("bigint").alias("pieces"), F.lit(blocks).cast("bigint").alias("blocks")) for pieces, blocks in shapes])
    asked = ids.select("event_id", F.explode(forms).alias("s")).select("event_id", "s.pieces", "s.blocks")
    asked = asked.select("*", _piece(F.col("pieces")).alias(PIECE), _block(F.col("blocks")).alias("block"))
    asked = F.broadcast(asked) if count * len(shapes) <= BROADCAST_IDS else asked.hint("shuffle_hash")
    filters = reduce(DataFrame.unionByName, [_filters(spark, *form, sets) for form in shapes])
    found = filters.join(asked, ["pieces", "blocks", PIECE, "block"]).withColumn("places", _bits())
    return found.where(" AND ".join(_holds(f"places[{n}]") for n in range(3))).select("set", PIECE, "event_id")


def _filters(spark: SparkSession, pieces: int, blocks: int, sets: list[IdSet]) -> DataFrame:
    """The filters of the sets of one shape."""
    paths = [s.filters for s in sets if (s.pieces, s.blocks) == (pieces, blocks)]
    read = spark.read.schema("set string, piece bigint, block bigint, bits binary").parquet(*paths)
    return read.select("*", F.lit(pieces).cast("bigint").alias("pieces"), F.lit(blocks).cast("bigint").alias("blocks"))


def read_sets(spark: SparkSession, sets: list[IdSet]) -> DataFrame:
    """All rows of some sets."""
    return spark.read.option("recursiveFileLookup", True).parquet(*[s.ids for s in sets])


def seen_in(spark: SparkSession, ids: DataFrame, count: int, sets: list[IdSet], condition: Column | None = None) -> DataFrame | None:
    """Which of ``count`` different ids the sets hold, or ``None`` if no filter knows any.

    The ids are stored. Only pieces whose filter may hold one of them are opened; ``condition`` limits the rows looked at.
    """
    if not sets or not count:
        return None
    hits = write_down(may_hold(spark, ids, count, sets))
    named = hits.select("set", PIECE).distinct().limit(NAMED_PIECES + 1).collect()
    if not named:
        return None
    places = {s.name: s.ids for s in sets}
    if len(named) <= NAMED_PIECES:
        rows = spark.read.parquet(*sorted(f"{places[row['set']]}/{PIECE}={row[PIECE]}" for row in named))
    else:
        rows = read_sets(spark, sets)
    if condition is not None:
        rows = rows.where(condition)
    asked = hits.select("event_id").distinct()
    # Rows pass by here as well: sorted, all that was ever accepted would be in memory.
    asked = F.broadcast(asked) if hits.count() <= BROADCAST_IDS else asked.hint("shuffle_hash")
    return rows.join(asked, "event_id", "left_semi").select("event_id").distinct()
