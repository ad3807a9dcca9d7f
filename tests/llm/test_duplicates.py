import random

import numpy as np
from gaugeworks.llm import simhash
from gaugeworks.llm.common import components
from gaugeworks.llm.fingerprint import fingerprint_of
from xxhash import xxh64_intdigest

SCHEMA = "doc_id long, text string, fingerprint string, component_id long"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(gram.encode(), 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(by_id):
    """Smallest id per class, over a matrix of all distances."""
    distinct = sorted(set(by_id.values()))
    numbers = np.array(distinct, dtype=np.uint64)
    label = {value: value for value in distinct}

    def root(value):
        while label[value] != value:
            value = label[value]
        return value

    for value in distinct:
        for other in np.nonzero(np.bitwise_count(numbers ^ np.uint64(value)) <= 2)[0]:
            a, b = sorted((root(value), root(distinct[other])))
            label[b] = a
    least = {}
    for doc_id, value in by_id.items():
        least[root(value)] = min(least.get(root(value), doc_id), doc_id)
    return {doc_id: least[root(value)] for doc_id, value in by_id.items()}


def test_fingerprints_are_as_defined():
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("abÀcD \t\n\x0b\x1c é") for _ in range(random.randint(0, 40)))
        assert fingerprint_of(text.encode()) == brute_fingerprint(text)
    assert fingerprint_of(None) == fingerprint_of(b" \n") == 0


def test_classes_are_those_of_all_pairs(spark):
    random.seed(2)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for n in range(120):
        text = random.choices(words, k=300)
        rows.append((3 * n, " ".join(text)))
        for copy in range(n % 4):
            text = text.copy()
            text[random.randrange(300)] = "changed"
            rows.append((3 * n + copy + 1000, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row.doc_id: row for row in simhash.near_duplicates(docs).collect()}
    by_id = {doc_id: brute_fingerprint(text) for doc_id, text in rows}
    assert {i: int(row.fingerprint, 16) for i, row in found.items()} == by_id
    want = brute_components(by_id)
    assert {i: row.component_id for i, row in found.items()} == want
    assert len(set(want.values())) < len(rows)


def test_crowded_keys_lose_no_link(spark):
    random.seed(3)
    base, values = random.getrandbits(64), set()
    for n in range(600):
        value = base if n % 2 else random.getrandbits(64)
        for bit in random.sample([3, 9, 17, 22, 30, 31, 44, 63], random.randint(0, 5)):
            value ^= 1 << bit
        values.add(value)
    want = brute_components({simhash._signed(value): value for value in values})
    distinct = spark.createDataFrame([(simhash._signed(value),) for value in values], "bits long")
    for crowd in (2, 10_000):
        got = {row.node: row.component for row in components(simhash.close_pairs(distinct, crowd)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_long_chain(spark):
    nodes = list(range(40))
    random.seed(4)
    random.shuffle(nodes)
    links = [(a, b) for a, b in zip(nodes, nodes[1:])] + [(100, 101), (None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in nodes}, 100: 100, 101: 100}


def test_nulls_empties_repeats_and_clashing_columns(spark):
    long = "x y z " * 50_000
    rows = [(1, None, "f", 9), (2, "", "f", 9), (3, "a b c d", "f", 9), (3, "a b c d", "f", 9), (None, "a b c d", "f", 9), (5, long, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (5, 5)], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 5, None]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0
