"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. Seeds are so short that a copy keeps one whatever words of it are replaced or
deleted, as long as it reaches the threshold, and with as many words inserted. A first pass over all documents counts in how many of them each n-gram of a
test item occurs. An item's rare seeds are, in every stretch of ``STRETCH`` n-grams, the ``RAREST`` that fewest documents hold
among those that occur at all. A second pass cuts out, around what a document shares with an item, the passage that may hold a
copy, and aligns it with the item word by word. Passages with a rare seed are aligned at once. Those held by common n-grams
alone are aligned too, unless they lack so many of the item's words that no alignment can reach the threshold. So nothing is
left out, however many documents carry the same copy. The score of the best local alignment, as a share of the item's own, decides.

What is sent to the executors are the test items, in slices of at most ``MAX_WORDS`` words, each with two passes of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import rows_with, write_down

#: Words of a seed at most; see ``seed_words``.
SEED_WORDS = 4
STRETCH = 10
RAREST = 2
SIMILARITY = 0.8
MAX_WORDS = 2_000_000
MISMATCH = GAP = 0.25
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def numbers_of(words: list[str]) -> np.ndarray:
    """A 64-bit number per word."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def grams_of(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number per run of ``size`` words; what shares a number is compared word by word later."""
    if len(numbers) < size:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(numbers) - size + 1, dtype=np.uint64)
    for place in range(size):
        grams = (grams ^ numbers[place : len(numbers) - size + 1 + place]) * _MIX
        grams ^= grams >> np.uint64(29)
    return grams


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(score, end): the best local alignment of two sequences of numbers, 1 per equal word, and where it ends."""
    steps = GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        fresh = np.maximum(row - GAP, 0.0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, 1.0, -MISMATCH))
        # Gaps along the row: the best earlier cell less a gap per step.
        row = np.maximum.accumulate(fresh + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def seed_words(size: int, similarity: float) -> int:
    """How long the seeds of an item of so many words are.

    A word that is replaced or deleted costs an alignment 1 and a quarter, so copies that reach the threshold lack ``lost`` words at
    most, and one of the runs between them is at least as long as an even share. The same holds for as many inserted words, one
    at least. Items of two words and one are seeds as a whole.
    """
    lost = int((1 - similarity) * size / (1 + MISMATCH) + 1e-9)
    replaced, inserted = -(-(size - lost) // (lost + 1)), -(-size // (max(lost, 1) + 1))
    return min(SEED_WORDS, size if size < 3 else min(replaced, inserted))


class Items:
    """Test items and the places of their n-grams."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY):
        self.ids, self.words, self.sizes = [], [], []
        places = defaultdict(list)
        for item_id, text in items:
            numbers = numbers_of(words_of(text or ""))
            if not len(numbers):
                continue
            size = seed_words(len(numbers), similarity)
            for place, gram in enumerate(grams_of(numbers, size).tolist()):
                places[size, gram].append((len(self.ids), place))
            self.ids.append(item_id)
            self.words.append(numbers)
            self.sizes.append(size)
        self.places = dict(places)
        self.rare: set[tuple] = set()
        self.grams = {
            size: np.array(sorted(gram for s, gram in self.places if s == size), dtype=np.uint64) for size in set(self.sizes)
        }

    def hits(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(size, gram, place) for each n-gram of a document that an item has too."""
        found = []
        for size, known in self.grams.items():
            grams = grams_of(numbers, size)
            if len(grams):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                places = np.nonzero(known[at] == grams)[0]
                found += [(size, gram, place) for gram, place in zip(grams[places].tolist(), places.tolist())]
        return found

    def seeds(self, counts: dict[tuple[int, int], int]) -> None:
        """Mark each item's rare grams, given the numbers of documents that hold them; grams that none holds go."""
        held = [[] for _ in self.ids]
        for gram, places in self.places.items():
            for item, place in places:
                if counts.get(gram, 0):
                    held[item].append((place, gram))
        self.rare = set()
        for item, grams in enumerate(held):
            stretches = defaultdict(list)
            for place, gram in grams:
                stretches[place // STRETCH].append((counts[gram], place, gram))
            for stretch in stretches.values():
                self.rare.update((item, gram) for _, _, gram in sorted(stretch)[:RAREST])
        self.places = {gram: places for gram, places in self.places.items() if counts.get(gram, 0)}
        self.grams = {size: np.array(sorted(gram for s, gram in self.places if s == size), dtype=np.uint64) for size in set(self.sizes)}
        self.grams = {size: grams for size, grams in self.grams.items() if len(grams)}

    def matches(self, numbers: np.ndarray, similarity: float) -> list[tuple]:
        """(item_id, score, first word, last word) of the best passage per item of one document."""
        shifts = defaultdict(dict)
        for size, gram, place in self.hits(numbers):
            for item, inside in self.places[size, gram]:
                rare = (item, (size, gram)) in self.rare
                shifts[item][place - inside] = rare or shifts[item].get(place - inside, False)
        found = []
        for item, starts in shifts.items():
            words = self.words[item]
            size = len(words)
            # So many words can be inserted into a copy that still reaches the threshold.
            room = max(8, int((1 - similarity) * size / GAP) + 1)
            best = (0.0, 0, 0)
            ordered = sorted(starts)
            first, seeded = ordered[0], False
            # Seeds whose shifts are close belong to one passage.
            for start, after in zip(ordered, [*ordered[1:], None]):
                seeded |= starts[start]
                if after is not None and after - start <= room and after - first <= 4 * size:
                    continue
                low, high = max(0, first - room), min(len(numbers), start + size + room)
                passage = numbers[low:high]
                # No alignment scores more than the item has words that the passage has too.
                if seeded or np.isin(words, passage).sum() >= similarity * size:
                    score, end = alignment(words, passage)
                    if score / size > best[0]:
                        length = alignment(words[::-1], passage[:end][::-1])[1] if score >= similarity * size else end
                        best = (score / size, low + end - length, low + end - 1)
                first, seeded = after, False
            if best[0] >= similarity:
                found.append((self.ids[item], *best))
        return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold a copy, exact or edited, of a test item.

    One row per row of ``docs`` and item, the best passage only. Null and empty texts hold none, and null or empty
    items are in none; null keys pass through; repeated rows repeat; repeated items are matched each; empty tables give an
    empty one. Texts of any length are read whole. Of ``docs`` only the two columns named are read, of ``benchmark`` only
    item_id and text.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    fields = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, last_word long"
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = int(words // max_words) + 1
    results = []
    for number in range(slices):
        part = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == number).select("item_id", "text")
        items = Items([tuple(row) for row in part.collect()], similarity)
        if items.ids:
            results.append(_pass(spark, texts, items, similarity, fields))
    if not results:
        return spark.createDataFrame([], fields)
    whole = results[0]
    for more in results[1:]:
        whole = whole.union(more)
    return whole


def _pass(spark, texts: DataFrame, items: Items, similarity: float, fields: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)

    def count(batches):
        import pyarrow as pa

        seen = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for size, gram, _ in {(s, g, 0) for s, g, _ in sent.value.hits(numbers_of(words_of(text)))}:
                    seen[size, gram] += 1
        if seen:
            sizes, grams = zip(*seen)
            arrays = [pa.array(sizes, pa.int32()), pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["size", "gram", "n"])

    # One row per gram of the items sent, however many documents there are.
    counted = texts.select("t").mapInArrow(count, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    counts = {(row["size"], row["gram"] & (1 << 64) - 1): row["n"] for row in counted.collect()}
    items.seeds(counts)
    seeded = spark.sparkContext.broadcast(items)

    def match(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *found) for found in seeded.value.matches(numbers_of(words_of(text)), similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema
                )

    target = spark.createDataFrame([], fields).schema
    return texts.mapInArrow(match, fields)


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item; columns are those of ``docs``. Rows with a null key stay."""
    found = write_down(contaminated(docs, benchmark, key=key, text=text).select("doc_id").distinct())
    return rows_with(docs, key, found, "left_anti")
