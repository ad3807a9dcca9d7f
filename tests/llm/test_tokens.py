import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
from gaugeworks.llm import bpe, token_counts, token_store
from gaugeworks.llm.common import BATCH_BYTES, small_batches, table, vocabulary
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

WORDS, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
ODD = list("abcdefghijklmnopqrstuvwxyz  \n\t.,0123ABCéñßЖ中😀'’ΣİıǅⅧ²½▁\x1c\x85") + [
    "<|endoftext|>", "<|startoftext|>", "<|", "é", "́", "'s", "'LL", " ", " ", "​", "\x00",
]


def odd_texts(count, seed):
    random.seed(seed)
    plain = ["the", "an", " ", "  ", "in ", "ing", "Tion", "'s", "1"]
    return ["".join(random.choice(ODD if n % 2 else plain) for _ in range(random.randint(0, 50))) for n in range(count)]


def test_encoding_and_decoding_are_the_librarys():
    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    for text in odd_texts(1500, 5) + ["x" * 3000 + "yz" * 500]:
        ids = library.encode(text, add_special_tokens=False).ids
        made = own.encode(text)
        assert np.frombuffer(made, "<u4").tolist() == ids, text
        assert own.decode(made) == library.decode(ids, skip_special_tokens=False)


def test_counts_are_the_librarys_however_texts_are_cut():
    library, machine = SentencePieceProcessor(model_file=PIECES), token_counts._machine(PIECES)
    for n, text in enumerate(odd_texts(1500, 6)):
        escaped = "▁" + text.replace(" ", "▁") if text else ""
        want = len(library.encode(text))
        assert machine.count(escaped) == want, text
        size = n % 19 + 1
        maps = [machine.chunk_map(escaped[at : at + size]) for at in range(0, len(escaped), size)]
        while len(maps) > 1:
            at = random.randrange(len(maps) - 1)  # composition is associative
            maps[at : at + 2] = [machine.compose(maps[at], maps[at + 1])]
        assert not maps or machine.total(maps[0]) == want


def test_forgetting_states_changes_no_count():
    machine, text = token_counts.CountingTransducer(token_counts._machine(PIECES).scores), "▁the▁thing▁they▁there"
    first = machine.count(text)
    machine.reset()
    machine.words.clear()
    assert machine.count(text) == first


def edge_rows():
    long = "".join(random.Random(8).choice(["ing ", "word", "  ", "é", "\n"]) for _ in range(70_000))
    return [(1, None), (2, ""), (3, "The thing."), (3, "The thing."), (None, "a  b"), (6, long)]


def test_token_counts_of_odd_rows(spark):
    library = SentencePieceProcessor(model_file=PIECES)
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, PIECES).collect()), key=repr)
    counts = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert got == sorted([(*row, row[2] > 4096) for row in counts], key=repr)
    assert len(rows[-1][1]) > 2 * token_counts.CHUNK_CHARS
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_round_trip_of_odd_rows(spark):
    library, rows = Tokenizer.from_file(WORDS), edge_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(bpe.round_trip(docs, WORDS)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digests = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode()
        want.append((i, len(ids), *(hashlib.sha256(part).hexdigest() for part in digests)))
    assert got == sorted(want, key=repr)
    again = bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()
    assert len(again) == len(rows)
    assert bpe.round_trip(docs.limit(0), WORDS).count() == 0


def test_token_files_of_odd_rows(spark):
    library, rows = Tokenizer.from_file(WORDS), edge_rows()
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, file int")
    got = sorted(map(tuple, token_store.store_and_read_back(docs, WORDS, 2).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda row: (row[0] is not None, row[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert token_store.store_and_read_back(docs.limit(0), WORDS, 2).count() == 0


def test_starts_run_on_over_files(spark):
    rows = [(n, "word " * (n % 7)) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = token_store.new_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = token_store.write_tokens(docs, WORDS, folder, 2)
        got = sorted(map(tuple, token_store.read_tokens(written, folder).collect()))
        assert written.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start = 0
    for (doc_id, first, n, _), (want, text) in zip(got, rows):
        assert (doc_id, first, n) == (want, start, len(text.split()) + 1)
        start += n
    assert token_store.read_documents(spark, folder, [8])[0][1][-1] == 2


def a_file():
    out = io.BytesIO()
    writer = token_store.Writer(out)
    docs = [(n, np.arange(n * 1000, n * 1000 + 9000, dtype="<u4").tobytes()) for n in range(20)]
    docs.append((99, np.arange(100_000, dtype="<u4").tobytes()))
    for doc in docs:
        writer.add(*doc)
    writer.close()
    return out.getvalue(), docs


def test_a_reader_decompresses_only_what_it_needs():
    from zstandard import ZstdDecompressor

    raw, docs = a_file()
    reader = token_store.Reader(io.BytesIO(raw))
    assert b"".join(reader.parts(3)) == docs[3][1] and reader.decompressed == 1
    assert len(reader.sums) > 8 and b"".join(reader.parts(20)) == docs[20][1]
    whole = ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(ids for _, ids in docs)


def test_damage_is_noticed():
    raw, _ = a_file()
    for place in (200, len(raw) - 3):
        damaged = bytearray(raw)
        damaged[place] ^= 0x55
        with pytest.raises(token_store.BadFrame):
            reader = token_store.Reader(io.BytesIO(bytes(damaged)))
            for document in range(len(reader.ids)):
                b"".join(reader.parts(document))


def test_long_texts_reach_python_in_small_batches(spark, tmp_path):
    spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    with small_batches(spark):
        found = table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(row.n for row in found) == 40 and max(row.bytes for row in found) <= BATCH_BYTES + (2 << 20)
