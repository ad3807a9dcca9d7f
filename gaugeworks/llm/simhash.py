"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets a table of its Hamming distances to fixed reference fingerprints: zero, and
32 references of two neighbouring set bits each. By the triangle inequality two fingerprints at distance d differ by at
most d in every coordinate. The distances to zero and to a two-bit reference also give the number of bits set in that
block (distance to zero - distance to the reference + 2, halved), so two fingerprints at distance 2 or less agree in all
blocks but two. The blocks are dealt into five groups; whatever two groups are left out, the other three make a join
key, and one of the ten keys is shared by every pair that has to be found. Pairs that share a key are discarded by their
maximum coordinate difference; the survivors are verified.

A key shared by more than ``crowd`` fingerprints would mean many pairs. Such fingerprints take the references next to
them instead: all 65 points at distance 1 or less. Two fingerprints at distance 2 or less share such a point, and any
two that share one are that close, at most 65 to a point. Nothing is dropped, whatever the size of a crowd.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import components, per_text, rows_with, unsigned_hex, write_down
from gaugeworks.llm.fingerprint import fingerprint_of

MAX_BITS = 2
BLOCKS = 32
GROUPS = 5
CROWD = 64


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


REFERENCES = [0] + [_signed(3 << 2 * block) for block in range(BLOCKS)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint as a long. Null and empty texts have 0; repeated rows repeat."""
    kind = docs.schema[key].dataType.simpleString()
    return per_text(
        docs,
        key,
        text,
        f"doc_id {kind}, bits long",
        lambda keys, texts: {"doc_id": keys, "bits": [_signed(fingerprint_of(t)) for t in texts]},
    )


def distance_table(bits: Column) -> Column:
    """Hamming distances to all references, in their order."""
    points = F.array(*[F.lit(point) for point in REFERENCES])
    return F.transform(points, lambda point: F.bit_count(bits.bitwiseXOR(point)).cast("byte"))


def _set_bits(zero: Column, far: Column) -> Column:
    """How many bits of a reference's block are set."""
    return F.shiftright(zero - far + 2, 1).cast("long")


def _keys(table: Column) -> Column:
    """The ten join keys, read off the distances to the references."""

    def code(group: int) -> Column:
        distances = F.array(*[table[place] for place in range(1 + group, 1 + BLOCKS, GROUPS)])
        return F.aggregate(distances, F.lit(0).cast("long"), lambda code, far: code * 3 + _set_bits(table[0], far))

    def key(number: int, kept: tuple[int, ...], codes: Column) -> Column:
        return F.aggregate(
            F.array(*[codes[group] for group in kept]), F.lit(number).cast("long"), lambda key, code: key * 3**7 + code
        )

    kept = list(enumerate(combinations(range(GROUPS), GROUPS - MAX_BITS)))
    codes = F.array(*[code(group) for group in range(GROUPS)])
    return F.transform(F.array(codes), lambda c: F.array(*[key(number, groups, c) for number, groups in kept]))[0]


def close_pairs(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among distinct fingerprints in column bits that join up all at ``MAX_BITS`` or less.

    All such pairs of uncrowded keys are there; a crowd's are joined through the smallest around a point.
    """
    tables = distinct.select("bits", distance_table(F.col("bits")).alias("table"))
    keyed = tables.select("bits", F.explode(_keys(F.col("table"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spread over the fingerprints too, as a crowded key may have many rows.
    salted = shared.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    salt = F.pmod(F.xxhash64("bits"), F.lit(16)).cast("int").alias("salt")
    shared_rows = write_down(keyed.select("*", salt).join(salted, ["key", "salt"]).select("key", "n", "bits"))
    few = shared_rows.where(F.col("n") <= crowd).select("key", "bits", distance_table(F.col("bits")).alias("table"))
    left = few.select("key", F.col("bits").alias("a"), F.col("table").alias("ta"))
    right = few.select("key", F.col("bits").alias("b"), F.col("table").alias("tb"))
    most = F.array_max(F.zip_with("ta", "tb", lambda x, y: F.abs(x - y)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & (most <= MAX_BITS) & near)
    pairs = pairs.select("a", "b").distinct()
    around = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)])
    points = (
        shared_rows.where(F.col("n") > crowd)
        .select("bits")
        .distinct()
        .select("bits", F.explode(around).alias("point"))
        .groupBy("point")
        .agg(F.min("bits").alias("a"), F.collect_list("bits").alias("all"))
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return pairs.union(points)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id), the latter the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and are linked like any others. Rows with a null key get the
    component of their fingerprint, null if no row of it has a key. Repeated rows repeat. An empty table
    gives an empty one. Columns other than the two named are not read.
    """
    marked = write_down(fingerprints(docs, key, text))
    distinct = write_down(marked.groupBy("bits").agg(F.min("doc_id").alias("first")))
    links = write_down(close_pairs(distinct, crowd))
    found = components(links)
    # Only linked fingerprints are re-labelled; the others keep their own first document.
    linked = found.join(distinct, F.col("node") == F.col("bits")).select("bits", "component", "first")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = write_down(linked.join(smallest, "component").select("bits", "component_id", F.lit(True).alias("is_linked")))
    classes = distinct.join(labels, "bits", "left").select(
        "bits",
        F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
    )
    # One fingerprint may have a third of all documents: its rows go to 32 places.
    spread = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))
    return salted.join(spread, ["bits", "salt"]).select(
        "doc_id", unsigned_hex(F.col("bits")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the document with the smallest key of each component, once.

    Rows with a null key cannot be told apart and stay. Columns are those of ``docs``.
    """
    found = near_duplicates(docs, key, text)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    stays = rows_with(docs, key, first, "left_semi")
    return stays.dropDuplicates([key]).union(docs.where(F.col(key).isNull()))
