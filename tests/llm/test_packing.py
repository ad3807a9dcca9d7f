import math
import random
import zlib

import numpy as np
from gaugeworks.llm import packing
from gaugeworks.llm.common import vocabulary, write_down
from tokenizers import Tokenizer

BYTES = vocabulary("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def checked(rows, length):
    """Sequences hold their pieces one after the other; returns how many there are."""
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return len(sequences)


def test_documents_are_cut_as_told():
    assert packing.cut_points(5, 8) == [(0, 5)] and packing.cut_points(8, 8) == [(0, 8)]
    assert packing.cut_points(19, 8) == [(0, 3), (3, 8), (11, 8)] and packing.cut_points(16, 8) == [(0, 8), (8, 8)]


def test_best_fit_takes_the_fullest_bin():
    random.seed(4)
    for _ in range(50):
        lengths, rooms = np.array([random.randint(1, 20) for _ in range(60)]), []
        bins, offsets = packing.best_fit(lengths, 20)
        for item in sorted(range(60), key=lambda n: -lengths[n]):  # brute force: look at every bin
            fitting = [room for room in rooms if room >= lengths[item]]
            room = min(fitting, default=20)
            assert 20 - offsets[item] == room
            if fitting:
                rooms.remove(room)
            rooms.append(room - lengths[item])
        assert len(rooms) == bins.max() + 1


def test_groups_are_merged_up_the_tree(spark):
    random.seed(5)
    for kind, slack in (("mixed", 1.05), ("large", 1.0), ("halves", 1.03)):
        sizes = {"mixed": lambda: random.randint(1, 100), "large": lambda: random.randint(51, 100), "halves": lambda: random.choice([50, 30, 20, 100])}[kind]
        lengths = [sizes() for _ in range(3000)]
        cut = write_down(spark.createDataFrame([(n, size) for n, size in enumerate(lengths)], "n long, length long").repartition(3))
        rows = packing.place(cut, 100, 150, 2).collect()
        assert sorted((row.n, row.length) for row in rows) == list(enumerate(lengths))
        best = max(math.ceil(sum(lengths) / 100), sum(size > 50 for size in lengths))
        assert checked(rows, 100) <= slack * best + 2, kind


def test_packed_documents_of_a_table(spark):
    docs, library = spark.read.parquet(f"{SMALL}/documents.parquet"), Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES, 2).collect()
    total, found = 0, {}
    for row in rows:
        found.setdefault(row.doc_id, []).append((row.piece, row.start, row.length, row.ids_crc32))
    for doc in docs.collect():
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = packing.cut_points(len(ids), 1024)
        total += len(ids)
        assert sorted(found[doc.doc_id]) == [(n, s, size, zlib.crc32(ids[s : s + size].tobytes())) for n, (s, size) in enumerate(parts)]
        assert all(size == 1024 for _, size in parts[1:])
    assert checked(rows, 1024) <= 1.03 * math.ceil(total / 1024)


def test_packing_of_odd_rows(spark):
    long = "The thing  is\n\nhere. " * 20_000
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1), (None, "a b", 1), (6, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    placed, library = packing.pack(docs, BYTES, 2).collect(), Tokenizer.from_file(BYTES)
    checked(placed, 1024)
    short = sorted(((row.doc_id, row.piece, row.length) for row in placed if row.doc_id != 6), key=repr)
    assert short == sorted([(1, 0, 1), (2, 0, 1), (3, 0, 3), (3, 0, 3), (None, 0, 3)], key=repr)
    assert sum(row.length for row in placed if row.doc_id == 6) == len(library.encode(long).ids) + 1
    made = packing.sequences(docs, BYTES, 2).collect()
    ids = np.concatenate([np.frombuffer(row.ids, "<u4") for row in made])
    want = [i for _, text, _ in rows for i in [*library.encode(text or "").ids, 2]]
    assert sorted(ids.tolist()) == sorted(want) and all(row.n_tokens == len(row.ids) // 4 <= 1024 for row in made)
    assert packing.pack(docs.limit(0), BYTES, 2).count() == 0
    assert packing.pieces(docs, BYTES, None).where("doc_id < 3").count() == 0
