import duckdb
import pytest
from __spark_entry__ import oracle_sql, queries
from pyspark.sql import functions as F
from test_documents import brute_score, brute_spans
from test_duplicates import brute_components, brute_fingerprint

import corpus_pipeline
from gaugeworks.llm import bpe, decontaminate
from gaugeworks.llm.common import vocabulary

SMALL = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = [name for name in queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", ["op8_top_inner_products", "op9_url_verdicts", "op12_collocations"])
def test_queries_agree_with_sql(spark, name):
    frame, connection = queries()[name](spark, SMALL), duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    columns = sorted(frame.columns)
    ours = sorted(map(repr, map(tuple, frame.select(*columns).collect())))
    assert ours == sorted(map(repr, connection.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()))


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = f"{tmp_path}/{number}"
        stage(spark, docs, SMALL).write.parquet(made)
        after = spark.read.parquet(made)
        assert number == 4 or after.columns == docs.columns
        kept.append((docs.collect(), after.collect()))
        docs = after
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = kept[0]
    stays = {row.doc_id for row in after}
    known = [(row.doc_id in stays, labels[row.doc_id] == 1) for row in before if row.doc_id in labels]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)
    before, after = kept[1]
    classes = brute_components({row.doc_id: brute_fingerprint(row.text) for row in before})
    assert sorted(row.doc_id for row in after) == sorted(set(classes.values()))
    before, after = kept[2]
    items = [decontaminate.words_of(row.text or "") for row in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = set()
    for row in before:
        words = decontaminate.words_of(row.text or "")
        for item in items:
            # Enough common words for an alignment to be worth the table.
            if item and len(set(item) & set(words)) >= 0.8 * len(set(item)) and brute_score(item, words) >= 0.8 * len(item):
                leaked.add(row.doc_id)
    assert {row.doc_id for row in before} - {row.doc_id for row in after} == leaked
    before, after = kept[3]
    texts = {row.doc_id: row for row in after}
    assert len(before) == len(after)
    for row in before:
        spans = brute_spans(row.text)
        new = texts[row.doc_id]
        assert new.n_chars == len(new.text) and (spans or new.text == row.text)
        assert all(row.text[start:end] not in new.text for start, end, _ in spans)
    before, after = kept[4]
    own = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    assert {row.doc_id: bytes(row.ids) for row in after} == {row.doc_id: own.encode(row.text) for row in before}


def test_run_gives_what_the_stages_give(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100


def test_stages_keep_odd_rows_as_they_say(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = "Word after word, line by line. " * 5000
    odd = [
        (9001, None, "fr", "web", None),
        (9002, "", None, "web", 0),
        (9003, "Write to a.b@c.de today.", "fr", None, 24),
        (9003, "Write to a.b@c.de today.", "fr", None, 24),
        (None, "A text without an id, but with 10.0.0.1 in it.", None, None, 5),
        (9006, long, "en", "web", len(long)),
    ]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("wanted", "Wanted_", "rejected_id", "kept_id", "component_id", "bits", "found", "t", "h", "k", "base")
    more = base.select(rows.columns).limit(40).unionByName(rows)
    for n, name in enumerate(names):
        more = more.withColumn(name, F.lit(n))
    for number, (title, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (more, more.limit(0)):
            after = stage(spark, docs, SMALL)
            assert number == 4 or after.columns == more.columns, title
            found = [row for row in after.collect() if row.doc_id is None or row.doc_id > 9000]
            if docs is not more:
                assert not found and after.count() == 0
                continue
            ids = sorted((row.doc_id for row in found), key=repr)
            if number in (2, 3, 4):
                assert ids == [9001, 9002, 9003, 9003, 9006, None], title
            if number == 0:
                assert None in ids and ids.count(9003) in (0, 2)
            if number == 1:
                # Null and empty texts are one group, and of a repeated row one stays.
                assert [i for i in ids if i in (9001, 9002)] == [9001] and ids.count(9003) == 1 and None in ids
            if number == 3:
                texts = {row.doc_id: (row.text, row.n_chars) for row in found}
                assert texts[9001] == (None, None) and texts[9002] == ("", 0) and texts[9003] == ("Write to [EMAIL] today.", 23)
                assert texts[None][0] == "A text without an id, but with [IP] in it."
            if number == 4:
                assert {row.n_tokens for row in found if row.doc_id in (9001, 9002)} == {0}
