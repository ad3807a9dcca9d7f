"""Token ids in files of independent zstandard frames with a trailing seek table.

A file has the documents of one range of ids, in ascending order:

- data frames: each is one zstandard frame of little-endian unsigned 32-bit ids, ended after the document that
  fills it (``FRAME_IDS``), or within a longer document;
- a skippable frame with the document table: count, then per document (null flag, doc_id, number of ids);
- a skippable frame with the seek table in zstandard's seekable format: per frame the compressed and the raw size and
  the low 32 bits of the XXH64 of the raw bytes; then the number of frames, a flag byte and a magic number.

Any zstandard decompressor reads the whole file, as it passes over skippable frames. A reader that wants some documents
reads the two tables and decompresses only the frames that hold them, checking each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import small_batches, write_down
from gaugeworks.llm.parts import library_encoder, pieces_of
from gaugeworks.session import shared_folder

FRAME_IDS = 1 << 15
LEVEL = 1
# Magic numbers of skippable frames and of the seek table.
_SKIPPABLE_DOCS, _SKIPPABLE_SEEK, _SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC, _FRAME, _FOOT, _HEAD = struct.Struct("<BqI"), struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")


class BadFrame(ValueError):
    """A frame's checksum or a table does not fit: the file is damaged."""


class Writer:
    """Writes one file; documents come in their order."""

    def __init__(self, out):
        from zstandard import ZstdCompressor

        self.out, self.press = out, ZstdCompressor(level=LEVEL)
        self.waiting, self.waiting_bytes = [], 0
        self.frames, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(_DOC.pack(doc_id is None, doc_id or 0, len(ids) // 4))
        step = 4 * FRAME_IDS
        for start in range(0, len(ids), step):  # a long document has frames of its own
            part = ids[start : start + step]
            self.waiting.append(part)
            self.waiting_bytes += len(part)
            if self.waiting_bytes >= step:
                self._end_frame()

    def _end_frame(self) -> None:
        from xxhash import xxh64_intdigest

        if self.waiting:
            raw = b"".join(self.waiting)
            pressed = self.press.compress(raw)
            self.out.write(pressed)
            self.frames.append(_FRAME.pack(len(pressed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.waiting_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        docs = struct.pack("<Q", len(self.docs)) + b"".join(self.docs)
        docs += struct.pack("<Q", len(docs) + 8)  # found from behind
        seek = b"".join(self.frames) + _FOOT.pack(len(self.frames), 0x80, _SEEK_MAGIC)
        for magic, body in ((_SKIPPABLE_DOCS, docs), (_SKIPPABLE_SEEK, seek)):
            self.out.write(_HEAD.pack(magic, len(body)) + body)


class Reader:
    """Reads documents of one file by their place, decompressing only the frames that hold them."""

    def __init__(self, source):
        source.seek(0, 2)
        size = source.tell()
        self.source, self.decompressed = source, 0
        count, flags, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != _SEEK_MAGIC or flags != 0x80:
            raise BadFrame("no seek table")
        seek = size - _FOOT.size - count * _FRAME.size
        frames = np.frombuffer(self._at(seek, count * _FRAME.size), dtype="<u4").reshape(-1, 3)
        self.pressed, self.raw, self.sums = frames[:, 0], frames[:, 1], frames[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.pressed, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.raw, dtype=np.int64)])
        (length,) = struct.unpack("<Q", self._at(seek - _HEAD.size - 8, 8))
        table = self._at(seek - _HEAD.size - length, length - 8)
        rows = np.frombuffer(table[8:], dtype=[("null", "u1"), ("id", "<i8"), ("n", "<u4")])
        if struct.unpack("<Q", table[:8])[0] != len(rows) or self.offsets[-1] + 2 * _HEAD.size + length + size - seek != size:
            raise BadFrame("tables do not fit the file")
        self.ids = [None if null else int(doc) for null, doc in zip(rows["null"], rows["id"])]
        self.counts = rows["n"].astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.kept: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, number: int) -> bytes:
        from xxhash import xxh64_intdigest
        from zstandard import ZstdDecompressor, ZstdError

        if self.kept[0] != number:
            try:
                raw = ZstdDecompressor().decompress(
                    self._at(int(self.offsets[number]), int(self.pressed[number])), int(self.raw[number])
                )
            except ZstdError as error:
                raise BadFrame(f"frame {number}: {error}") from error
            if xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[number]:
                raise BadFrame(f"frame {number}: checksum")
            self.decompressed += 1
            self.kept = (number, raw)
        return self.kept[1]

    def parts(self, place: int) -> Iterator[bytes]:
        """The ids of the document at a place, frame by frame."""
        at, end = 4 * int(self.firsts[place]), 4 * int(self.firsts[place + 1])
        number = int(np.searchsorted(self.starts, at, "right")) - 1
        while at < end:
            first = int(self.starts[number])
            raw = self._frame(number)
            yield raw[at - first : end - first]
            at, number = first + len(raw), number + 1


def _file_system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_tokens(
    docs: DataFrame, path: str, folder: str, end_id: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode all texts and write them to ``folder``; returns (part, file, n_docs, n_ids), one row per file.

    Documents are dealt out by ranges of ``key`` and sorted, so the files, in the order of their parts, hold them in
    ascending order (null keys first; repeated keys next to each other). Null and empty texts have no ids but ``end_id``.
    A part is written under a name of its attempt and then renamed, so a repeated task changes nothing. An empty table
    gives no rows. Columns other than the two named are not read; ``key`` is an integer.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(path, False)
        part = TaskContext.get().partitionId()
        files, base = _file_system(folder)
        ending = b"" if end_id is None else struct.pack("<I", end_id)
        writer = out = None
        docs_seen = ids_seen = 0
        name = f"{base}/part-{part:06d}.zst"
        attempt = f"{base}/.{uuid.uuid4().hex}"
        for batch in batches:
            for piece in pieces_of(batch, 1):
                if writer is None and piece.num_rows:
                    files.create_dir(base)
                    out = files.open_output_stream(attempt)
                    writer = Writer(out)
                ids, counts = encoder.encode(piece.column(1).fill_null(""))
                ends = np.cumsum(counts)
                for doc_id, first, last in zip(piece.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    writer.add(doc_id, ids[first:last].tobytes() + ending)
                docs_seen += piece.num_rows
                ids_seen += len(ids) + piece.num_rows * (len(ending) // 4)
        if writer is not None:
            writer.close()
            out.close()
            files.move(attempt, name)
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "n_docs": [docs_seen], "n_ids": [ids_seen]}
            )

    # The ranges are found from the ids alone; texts are encoded where they then lie. Rows that repeat an id are parted by text.
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    sorted_docs = narrow.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    with small_batches(docs.sparkSession):
        return write_down(sorted_docs.mapInArrow(run, "part long, file string, n_docs long, n_ids long"))


def read_tokens(written: DataFrame, folder: str) -> DataFrame:
    """Read all files back: (doc_id, start, n_tokens, ids_crc32), one row per document.

    ``start`` is the number of ids of all documents before it. The files' totals are few: one row each.
    """

    def run(batches):
        import pyarrow as pa

        files, _ = _file_system(folder)
        for batch in batches:
            for name, base in zip(*(column.to_pylist() for column in batch.columns)):
                with files.open_input_file(name) as source:
                    reader = Reader(source)
                    sums = []
                    for place in range(len(reader.ids)):
                        check = 0
                        for part in reader.parts(place):
                            check = zlib.crc32(part, check)
                        sums.append(check)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.ids, pa.int64()),
                        pa.array(reader.firsts[:-1] + base, pa.int64()),
                        pa.array(reader.counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = written.select("file", before.alias("base"))
    # As many tasks as files, up to a bound: by their few bytes alone all would be put into one.
    spread = places.repartition(max(1, min(written.count(), 10_000)), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark, folder: str, doc_ids: list[int]) -> list[tuple[int, list[int]]]:
    """The ids of some documents, for a person who looks at them: opens each file's tables, and their frames only."""
    files, base = _file_system(folder)
    from pyarrow.fs import FileSelector

    wanted, found = set(doc_ids), []
    names = sorted(file.path for file in files.get_file_info(FileSelector(base)) if file.path.endswith(".zst"))
    for name in names:
        with files.open_input_file(name) as source:
            reader = Reader(source)
            for place, doc_id in enumerate(reader.ids):
                if doc_id in wanted:
                    found.append((doc_id, np.frombuffer(b"".join(reader.parts(place)), dtype="<u4").tolist()))
    return found


def new_folder(spark) -> str:
    """A folder of its own below the one that all executors share."""
    root = shared_folder(spark).rstrip("/")
    return f"{root if '://' in root else 'file://' + root.removeprefix('file:')}/tokens-{uuid.uuid4().hex}"


def store_and_read_back(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids with ``end_id`` after each, and read the files back."""
    folder = new_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, path, folder, end_id, key, text), folder)
