"""Ordered operators over keys of any size.

A window partitioned by device puts that device's whole history into one task. Here every key is cut
into consecutive *slices* instead. Windows run inside (key, slice); what a row needs from outside its
slice travels through a table of one row per slice, which is the only thing ordered per key.

Slices are calendar pieces of the key's time. A piece that holds too many rows (a burst, or many copies
of one timestamp) is cut further by sorting its rows into ranges, so no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.timegrid import DAY_US, floor_to_step, micros
from gaugeworks.session import planned_ahead, write_down

SLICE = "_slice"
# A calendar piece is cut further above this many rows; some 100 MB of readings.
MAX_SLICE_ROWS = 1_000_000
# Room for range numbers inside one slice number: as many as Spark can number partitions.
_RANGES = 1 << 31
# With that room, pieces this long fit a slice number for 136 years around 1970.
_LEAST_WIDTH_US = 1_000_000
# Crowded pieces are few: each holds more than MAX_SLICE_ROWS rows, so 10^12 rows give under 10^6.
_BROADCAST_PIECES = 1_000_000
# Keys whose one row each is sent to every task; some 100 MB.
_BROADCAST_KEYS = 1_000_000
# Places that the rows of one key are spread over where they are in no slices.
_SALTS = 64


@dataclass(frozen=True)
class SlicedRows:
    """Rows with non-null keys and time, and the slice each one belongs to."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    row_count: int | None = None
    laid_out: bool = False

    @property
    def within(self) -> list[str]:
        return [*self.keys, SLICE]

    def select(self, *columns: str | Column) -> SlicedRows:
        """Keep the slicing columns and the given ones."""
        fixed = [*self.within, *self.order]
        extra = [c for c in columns if not (isinstance(c, str) and c in fixed)]
        return replace(self, rows=self.rows.select(*fixed, *extra))


def calendar_slice(time: str, width_us: int = DAY_US) -> Column:
    """The slice that a row's time belongs to while its piece of the calendar is not crowded."""
    return F.expr(f"unix_micros({time}) div {width_us}") * _RANGES


def slice_rows(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    width_us: int = DAY_US,
    max_rows: int = MAX_SLICE_ROWS,
    counted: DataFrame | None = None,
) -> SlicedRows:
    """Cut rows into slices; ``order[0]`` is the time column, the rest break ties.

    Looking for crowded pieces is one counting job over the key columns, unless ``counted`` has the ``_rows`` of each key and
    ``calendar_slice`` already. Without any, which is the usual case, the result stays lazy and costs no shuffle of its own.
    """
    if width_us < _LEAST_WIDTH_US:
        raise ValueError(f"width_us must be at least {_LEAST_WIDTH_US}, got {width_us}")
    keys, order = tuple(keys), tuple(order)
    frame = frame.withColumn(SLICE, calendar_slice(order[0], width_us))
    if counted is None:
        counted = frame.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    too_many = F.col("_rows") > max_rows
    row_count, pieces, crowded_rows = counted.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)), F.count_if(too_many), F.sum(F.when(too_many, F.col("_rows")))
    ).first()
    if pieces == 0:
        return SlicedRows(frame, keys, order, row_count)

    crowded = counted.filter(too_many).drop("_rows")
    crowded = write_down(crowded)
    within = [*keys, SLICE]
    if pieces <= _BROADCAST_PIECES:
        crowded = F.broadcast(crowded)
    calm = frame.join(crowded, within, "left_anti")
    # The last range column tells exact copies apart; they are interchangeable, so any order will do.
    # The checkpoint fixes range numbers before anything reads them twice.
    ranged = write_down(
        frame.join(crowded, within, "left_semi")
        .withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(-(-crowded_rows // max_rows) + 1, *keys, *order, "_copy")
        .withColumn(SLICE, F.col(SLICE) + F.spark_partition_id())
        .drop("_copy")
    )
    return SlicedRows(calm.unionByName(ranged), keys, order, row_count)


def slice_grid(
    frame: DataFrame, keys: Sequence[str], time: str, step_us: int, steps: int = 100_000
) -> SlicedRows:
    """Slices of rows on a time grid: one row per key and step, so at most ``steps`` rows each."""
    start = floor_to_step(micros(F.col(time)), step_us * steps)
    return SlicedRows(frame.withColumn(SLICE, start), tuple(keys), (time,))


def neighbours(
    sliced: SlicedRows, values: Mapping[str, Column], *, following: bool = False
) -> DataFrame:
    """Add to every row the nearest non-null value before it, and optionally after it.

    For each ``name`` in ``values`` the columns ``<name>_before`` and ``<name>_after`` hold that value
    from another row of the same key, however many slices away. All values share one shuffle and sort.
    """
    within, keys = sliced.within, list(sliced.keys)
    passed = Window.unboundedPreceding, -1
    ascending = Window.partitionBy(*within).orderBy(*sliced.order)
    descending = Window.partitionBy(*within).orderBy(*[F.desc(name) for name in sliced.order])

    # Keys are not null anyway. Said here it is known of both uses of the rows, and the joins add no check to one of them only.
    rows = sliced.rows
    for name in within:
        rows = rows.where(F.col(name).isNotNull())
    local = rows.select(
        "*",
        *[
            F.last(value, ignorenulls=True).over(ascending.rowsBetween(*passed)).alias(f"{name}_before")
            for name, value in values.items()
        ],
        F.lead(F.lit(True)).over(ascending).isNull().alias("_closes"),
    )
    # A frame that ends at the partition's end is recomputed for every row; walking backwards is not.
    if following:
        local = local.select(
            "*",
            *[
                F.last(value, ignorenulls=True)
                .over(descending.rowsBetween(*passed))
                .alias(f"{name}_after")
                for name, value in values.items()
            ],
            F.lead(F.lit(True)).over(descending).isNull().alias("_opens"),
        )

    before_slice = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*passed)
    after_slice = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(*passed)

    # Always true, and asked of closing rows only: as it names every column, the edges' use of the rows is planned like the
    # rows' own, and both share one evaluation up to the shuffle. Else each would be pruned to columns of its own.
    whole = F.xxhash64(*sliced.rows.columns) >= F.lit(-(1 << 63))

    def edge(side: str, flag: str) -> DataFrame:
        return local.filter(F.col(flag) & whole).select(
            *within,
            *[
                F.coalesce(value, F.col(f"{name}_{side}")).alias(f"_{name}_{side}")
                for name, value in values.items()
            ],
        )

    def carried(side: str, flag: str, window: Window) -> DataFrame:
        return edge(side, flag).select(
            *within,
            *[
                F.last(f"_{name}_{side}", ignorenulls=True).over(window).alias(f"_{name}_{side}")
                for name in values
            ],
        )

    # Left joins, though every row finds its slice: an inner join would add null checks to one use of
    # the rows only, and the two uses would no longer share one shuffle.
    joined = local.join(carried("before", "_closes", before_slice), within, "left")
    if following:
        joined = joined.join(carried("after", "_opens", after_slice), within, "left")
    sides = ["before", "after"] if following else ["before"]
    return joined.select(
        *sliced.rows.columns,
        *[
            F.coalesce(F.col(f"{name}_{side}"), F.col(f"_{name}_{side}")).alias(f"{name}_{side}")
            for name in values
            for side in sides
        ],
    )


def attach_per_key(sliced: SlicedRows, rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """Join one row per key onto all rows of that key, wherever the rows are.

    The table is written down first: it is small next to the rows, and its size decides the join. Up to
    ``_BROADCAST_KEYS`` keys it goes to every task. Beyond, it is spread over each key's slices, so that
    the rows keep their partitioning by (key, slice) and a large key stays spread out.
    """
    per_key = write_down(per_key)
    if per_key.count() <= _BROADCAST_KEYS:
        return rows.join(F.broadcast(per_key), list(sliced.keys), "left")
    spread = sliced.rows.select(*sliced.within).distinct().join(per_key, list(sliced.keys))
    return rows.join(spread, sliced.within, "left")


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Join one row per key onto rows that are in no slices; a key may have any number of rows.

    ``per_key`` is written down and its size decides: few keys go to every task, more are copied ``_SALTS`` times, so that
    the rows of a large key, told apart by the column ``spread``, meet them in as many places.
    """
    per_key = write_down(per_key)
    if per_key.count() <= _BROADCAST_KEYS:
        return rows.join(F.broadcast(per_key), list(keys))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def gather(sliced: SlicedRows) -> SlicedRows:
    """Write the rows down once, laid out by (key, slice) and sorted, for several ordered operators.

    What reads the result finds the layout it needs and neither shuffles nor sorts again. Slices are
    small, so hashing them gives even partitions; there are as many as the counted rows ask for.
    """
    spark = sliced.rows.sparkSession
    with planned_ahead(spark):
        partitions = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            -(-(sliced.row_count or 0) // MAX_SLICE_ROWS),
        )
        laid_out = sliced.rows.repartition(partitions, *sliced.within).sortWithinPartitions(
            *sliced.within, *sliced.order
        )
        return replace(sliced, rows=write_down(laid_out), laid_out=True)
