"""Best-fit packing of documents into sequences of bounded length, by hierarchical residual packing.

Documents are dealt into groups of bounded size. Each group is packed best fit, the longest first: an item goes to the bin whose
room it leaves least of. Bins that are full but for a few places are done. The others, whole, are the items of the next round,
in which neighbouring groups are merged into as many as the bins left over need, and so on up the tree, until one group is left
or a merge would be no smaller than what it merges: then the bins left over are of a kind that fits nowhere. A group never holds
more than some ``GROUP`` items, however many documents there are, and only lengths and places move, never ids.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import write_down
from gaugeworks.llm.parts import library_encoder, pieces_of

LENGTH = 1024
#: Items that are packed together.
GROUP = 1 << 14
#: A bin with so much room or less is done.
NEARLY = 4


def cut_points(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first are as long as a sequence."""
    first = tokens % length or length
    starts = [0, *range(min(first, tokens), tokens, length)]
    return [(start, end - start) for start, end in zip(starts, [*starts[1:], tokens])]


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered from 0. Of equally good bins the last opened or filled one is taken."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = opened = 0  # a bit per room that some bin has
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        enough = open_rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, chosen = length, opened
            opened += 1
        bins[item], offsets[item] = chosen, length - room
        left = room - size
        if left:
            rooms[left].append(chosen)
            open_rooms |= 1 << left
    return bins, offsets


def pieces(docs: DataFrame, path: str, end_id: int | None, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``keep_ids`` also the ids as a binary: the pieces of every document.

    Null and empty texts have ``end_id`` alone, without one no piece. Null keys and repeated rows pass through.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches):
        encoder, ending = library_encoder(path, True), [] if end_id is None else [end_id]
        for batch in batches:
            for part in pieces_of(batch, 1):
                ids, counts = encoder.encode(part.column(1).fill_null(""))
                if ending:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                raw, first, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for row, tokens in enumerate(counts.tolist()):
                    if tokens:
                        for number, (start, size) in enumerate(cut_points(tokens, length)):
                            mine = raw[4 * (first + start) : 4 * (first + start + size)]
                            rows.append((row, number, start, size, zlib.crc32(mine), bytes(mine) if keep_ids else None))
                    first += tokens
                row, number, start, size, crc, data = zip(*rows) if rows else [()] * 6
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(values, pa.int64()) for values in (start, size, crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(data, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def _packed(items: DataFrame, length: int) -> DataFrame:
    """Bins (group, place, fill, members) of items (group, fill, members), packed group by group."""
    schema = f"group long, place long, fill long, members {items.schema['members'].dataType.simpleString()}"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fills = table["fill"].to_numpy()
        bins, offsets = best_fit(fills, length)
        order = np.lexsort((offsets, bins))
        members = table["members"].combine_chunks()
        starts = members.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(starts)[order]
        ends = np.cumsum(sizes)
        taken = np.repeat(starts[:-1][order] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        n = int(bins.max()) + 1
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bins[order], weights=sizes, minlength=n).astype(np.int64))])
        moved = members.values.take(pa.array(taken))
        # Made of its fields again, as columns that are never null would not fit the schema.
        moved = pa.StructArray.from_arrays([moved.field(n) for n in range(moved.type.num_fields)], [field.name for field in moved.type])
        made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), moved)
        filled = np.bincount(bins, weights=fills, minlength=n).astype(np.int64)
        group = np.full(n, table["group"][0].as_py(), np.int64)
        return pa.table([pa.array(group), pa.array(np.arange(n)), pa.array(filled), made], ["group", "place", "fill", "members"])

    return items.groupBy("group").applyInArrow(run, schema)


def place(cut: DataFrame, length: int = LENGTH, group: int = GROUP, nearly: int = NEARLY) -> DataFrame:
    """The rows of ``cut``, a table with a column ``length`` of 1 to ``length``, with their (sequence_id, offset).

    Rows that are alike are placed each; an empty table gives an empty one. ``cut`` is read more than once, so it should be
    written down. Which of several equally good places a row gets follows the order of its rows.
    """
    count = cut.count()
    groups = max(1, math.ceil(count / group))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    items = cut.select(dealt.alias("group"), F.col("length").cast("long").alias("fill"), F.array(F.struct("*")).alias("members"))
    done, level = [], 0
    while True:
        bins = write_down(_packed(items, length))
        left = bins.where(F.col("fill") < length - nearly)
        merged = max(1, math.ceil(left.count() / group))
        last = groups == 1 or merged >= groups
        ended = bins if last else bins.where(F.col("fill") >= length - nearly)
        number = F.lit(level << 56).bitwiseOR(F.shiftleft("group", 28)).bitwiseOR(F.col("place"))
        done.append(ended.select(number.alias("sequence_id"), "members"))
        if last:
            break
        # Neighbours come together: group g of G goes to g * M / G of M.
        items = left.select(F.expr(f"group * {merged} div {groups}").alias("group"), "fill", "members")
        groups, level = merged, level + 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    before = F.aggregate(
        "members",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda sum, m: F.struct((sum["at"] + m["length"]).alias("at"), F.concat(sum["all"], F.array(sum["at"])).alias("all")),
        lambda sum: sum["all"],
    )
    rows = found.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), before.alias("offset"))).alias("r"))
    return rows.select("r.m.*", "sequence_id", F.col("r.offset").alias("offset"))


def pack(docs: DataFrame, path: str, end_id: int | None, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document is put.

    Documents longer than ``length`` are cut, the others stay whole. Texts of any length are read whole; null and empty texts have
    ``end_id`` alone; null keys and repeated rows are packed like others; an empty table gives an empty one. Columns other
    than the two named are not read.
    """
    return place(write_down(pieces(docs, path, end_id, length, key, text)), length)


def sequences(docs: DataFrame, path: str, end_id: int | None, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, ids as little-endian unsigned 32-bit numbers."""
    cut = write_down(pieces(docs, path, end_id, length, key, text, True)).withColumn("row", F.monotonically_increasing_id())
    placed = place(cut.select("row", "length"), length).select("row", "sequence_id", "offset")
    joined = cut.select("row", "ids").join(placed, "row").groupBy("sequence_id")
    parts = joined.agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda made, part: F.concat(made, part["ids"]))
    return parts.select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
