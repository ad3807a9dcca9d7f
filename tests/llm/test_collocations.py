import random
from collections import Counter

import duckdb
import numpy as np
from gaugeworks.llm import collocations
from gaugeworks.llm.collocations import Filter, Trie, Words, _by_language, _texts

SMALL = "/root/testdata/sf0.01"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_sql(documents, **more):
    connection = duckdb.connect()
    connection.register("documents", documents) if not isinstance(documents, str) else connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    return sorted(connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({collocations.oracle(**more)})").fetchall())


def test_phrases_of_a_table(spark):
    path = f"{SMALL}/documents.parquet"
    got = sorted(map(tuple, collocations.mine(spark.read.parquet(path)).select(*COLUMNS).collect()))
    assert got == by_sql(path) and len(got) > 100


def test_lower_bounds_many_shards_and_saturated_filters(spark, monkeypatch):
    random.seed(3)
    words = [f"w{n}" for n in range(12)] + ["New", "york", "é", "\x00", "ß"]
    texts = []
    for n in range(300):
        text = "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", " - "]) for _ in range(30))
        texts.append(text.replace("w3 w4", "w3 w4 w5 w6"))
    rows = [(n % 7, text, ["en", "de", None][n % 3], 1) for n, text in enumerate(texts)] + [(1, None, "en", 1), (None, "", "fr", 1), (2, "new YORK " * 3000, "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, rank int").repartition(3)
    monkeypatch.setattr(collocations, "KEPT", 50)
    monkeypatch.setattr(collocations, "PACKED", 70)
    for bits in (1 << 27, 1 << 10):  # the second lets nearly everything through
        monkeypatch.setattr(collocations.Filter.__init__, "__defaults__", (bits,))
        got = sorted(map(tuple, collocations.mine(docs, least=4, top=40, shard=100).select(*COLUMNS).collect()))
        assert got == by_sql(docs.toPandas(), least=4, top=40)
    assert collocations.mine(docs.limit(0)).count() == collocations.mine(docs, least=10**6).count() == 0


def test_tries_count_all_positions():
    random.seed(4)
    for _ in range(40):
        text = [random.randint(0, 9) for _ in range(400)]
        piece = np.cumsum([random.random() < 0.1 for _ in text]).astype(np.int32)
        phrases = sorted({tuple(random.randint(1, 9) for _ in range(random.randint(1, 4))) for _ in range(60)})
        random.shuffle(phrases)
        trie, counts = Trie(phrases, 9), np.zeros(len(phrases), np.int64)
        trie.count(np.array(text, np.int32), piece, counts)
        seen = Counter(tuple(text[at : at + size]) for size in range(1, 5) for at in range(401 - size) if piece[at] == piece[at + size - 1])
        assert counts.tolist() == [seen[phrase] for phrase in phrases]


def test_filters_hold_what_they_were_made_of(spark):
    frame = spark.range(2000).selectExpr("xxhash64('de', cast(id as string)) AS h")
    made = Filter(frame)
    assert made.holds(collocations._hashes("de", [str(n) for n in range(2000)])).all()
    assert made.holds(collocations._hashes("de", [f"x{n}" for n in range(2000)])).mean() < 0.1
    assert len(Filter(frame.limit(0)).words) == 32


def test_words_are_cut_as_told(spark):
    docs = spark.createDataFrame([("A b\x0b. C\x1cd,,é", "en")], "text string, lang string")
    batch = _texts(docs, "text", "lang").toArrow().combine_chunks().to_batches()
    ((lang, words),) = _by_language(batch)
    assert lang == "en" and isinstance(words, Words)
    assert [words.distinct[int(n)].as_py() for n in words.which] == ["a", "b", "c\x1cd", "é"]
    assert words.together(2).tolist() == [0]


def test_buckets_are_packed_whole():
    random.seed(5)
    buckets = np.array([random.choice([random.randrange(1 << 23), 7]) for _ in range(3000)], np.uint64)
    counts = Counter()
    for number, data in collocations._packed(buckets, 9):
        for place, count in zip(*collocations._unpacked(data)):
            counts[number * collocations.WIDTH + int(place)] = int(count)
    assert counts == {bucket: min(9, count) for bucket, count in Counter(buckets.tolist()).items()}
