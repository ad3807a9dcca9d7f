"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

For a word of n symbols the tree has one leaf per adjacent pair, holding (rank, place) as one number; inner nodes hold
the smaller child, so the root is the leftmost merge of lowest rank. A merge changes two neighbouring
leaves and empties one: three updates of logarithmic length. It ends when the root holds no merge. A word of any length
thus takes n log n steps.

The vocabulary file's own rules decide what a word is: special tokens are cut out of the raw text, the rest is
normalised (NFC, white space, lower case), split by the file's pattern and mapped byte by byte.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import per_text
from gaugeworks.llm.parts import LONGEST, PartEncoder, binaries, byte_characters, pieces_of

#: Words remembered in each of two generations.
GENERATION = 100_000
_NONE = 1 << 80
#: A word of the file's pattern and perhaps a sign, composed already.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch
#: Characters with Unicode's White_Space property.
_WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def merged(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols of one word when no pair can be merged any more.

    ``merges`` maps a pair (left << 20 | right) to rank << 20 | symbol made. A leaf is that number << 32 | place.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:  # one leaf only
        merge = merges.get(symbols[0] << 20 | symbols[1])
        return symbols if merge is None else [merge & 0xFFFFF]
    width = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * width)
    find = merges.get
    node, left = width, symbols[0]
    for right in symbols[1:]:
        merge = find(left << 20 | right)
        if merge is not None:
            tree[node] = merge << 32 | node - width
        node, left = node + 1, right
    for node in range(width - 1, 0, -1):
        one, two = tree[2 * node], tree[2 * node + 1]
        tree[node] = one if one < two else two
    before, after = list(range(-1, n)), list(range(1, n + 1))
    while (root := tree[1]) < _NONE:
        place = root & 0xFFFFFFFF
        gone = after[place]
        left = symbols[place] = root >> 32 & 0xFFFFF
        symbols[gone] = -1
        following = after[place] = after[gone]
        before[following] = place
        weight = _NONE
        if following < n and (merge := find(left << 20 | symbols[following])) is not None:
            weight = merge << 32 | place
        changes = [(place, weight)]
        if gone < width and tree[gone + width] < _NONE:
            changes.append((gone, _NONE))
        previous = before[place]
        if previous >= 0:
            merge = find(symbols[previous] << 20 | left)
            changes.append((previous, _NONE if merge is None else merge << 32 | previous))
        for place, weight in changes:
            node = place + width
            if tree[node] == weight:
                continue
            tree[node] = weight
            while node > 1:
                one, two = tree[node], tree[node ^ 1]
                node >>= 1
                if two < one:
                    one = two
                if tree[node] == one:
                    break
                tree[node] = one
    return [symbol for symbol in symbols if symbol >= 0]


class WordBpe:
    """Encoder and decoder for a vocabulary file with lower-cased words and word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, normal = rules["model"], [step["type"] for step in rules["normalizer"]["normalizers"]]
        split, byte_level = rules["pre_tokenizer"]["pretokenizers"]
        expected = (
            model["type"] == "BPE"
            and normal == ["NFC", "Replace", "Lowercase"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and (byte_level["type"], byte_level["use_regex"]) == ("ByteLevel", False)
            and not (model["continuing_subword_prefix"] or model["unk_token"] or rules["decoder"])
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        )
        if not expected:
            raise ValueError("this vocabulary file has rules that the operator does not know")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {number: token for token, number in vocabulary.items()}
        self.special = {token["content"]: token["id"] for token in rules["added_tokens"]}
        self.tokens |= {number: token for token, number in self.special.items()}
        self.merges = {
            vocabulary[left] << 20 | vocabulary[right]: rank << 20 | vocabulary[left + right]
            for rank, (left, right) in enumerate(map(tuple, model["merges"]))
        }
        self.inner = [vocabulary.get(char) for char in byte_characters()]
        self.last = [vocabulary.get(char + end) for char in byte_characters()]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts = PartEncoder(lambda parts: [self._part(part) for part in parts])
        numbers = range(max(self.tokens) + 1)
        self.written = pa.array([self.tokens.get(number) for number in numbers], pa.string())

    def word(self, word: str) -> bytes:
        """Ids of one word as the pattern cuts it."""
        known = self.young.get(word)
        if known is None:
            known = self.old.get(word)
            if known is None:
                raw = word.encode()
                # The last character has the word-end mark; bytes that stand for themselves come one by one.
                symbols = [self.inner[byte] for byte in raw[:-1]] + [self.last[raw[-1]]]
                ids = merged([symbol for symbol in symbols if symbol is not None], self.merges)
                known = pack(f"<{len(ids)}I", *ids)
            if len(word) < LONGEST:
                self.young[word] = known
                if len(self.young) >= GENERATION:
                    self.young, self.old = {}, self.young
        return known

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = _WHITE.sub(" ", text).lower()
        return b"".join([self.word(word) for word in self.pattern.findall(text)])

    def _part(self, part: str) -> bytes:
        """Ids of a part between blanks, which end words."""
        if match := _PLAIN(part):
            word, sign = match.groups()
            ids = self.word(word.lower())
            return ids + self.word(sign) if sign else ids
        if "<" not in part:
            return self._ordinary(part)
        ids, at = [], 0
        for special in self.cut.finditer(part):
            ids += [self._ordinary(part[at : special.start()]), pack("<I", self.special[special[0]])]
            at = special.end()
        return b"".join([*ids, self._ordinary(part[at:])])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        return self.parts.encode(pa.array([text]))[0].tobytes()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts that ``counts`` ids each decode to: tokens joined by blanks, as the file names no decoder; numbers it does
        not have are left out."""
        known = ids < len(self.written)
        tokens = self.written.take(pa.array(np.where(known, ids, 0)))
        if not known.all():
            tokens = pc.if_else(pa.array(known), tokens, pa.scalar(None, pa.string()))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if tokens.null_count:
            kept = tokens.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            tokens = tokens.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4")
        return self.decode_all(numbers, np.array([len(numbers)]))[0].as_py()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, ids), ids a binary of little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids; null keys and repeated rows pass through; an empty table gives an empty one.
    Texts of any length are encoded whole. Columns other than the two named are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    return per_text(
        docs,
        key,
        text,
        f"doc_id {kind}, ids binary",
        lambda keys, texts: {"doc_id": keys, "ids": [encoder(path).encode((t or b"").decode()) for t in texts]},
    )


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) for a table of ids as ``encode`` makes them; null ids give an empty text."""
    kind = encoded.schema[key].dataType.simpleString()
    return per_text(
        encoded,
        key,
        ids,
        f"doc_id {kind}, text string",
        lambda keys, rows: {"doc_id": keys, "text": [encoder(path).decode(row or b"") for row in rows]},
    )


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` of what it made, in one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for piece in pieces_of(batch, 1):
                ids, counts = bpe.parts.encode(piece.column(1).fill_null(""))
                columns = [piece.column(0), binaries(ids, counts), bpe.decode_all(ids, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(trips: DataFrame, *more: str) -> DataFrame:
    """Per row of ``round_trip``: (doc_id, columns named, n_tokens, ids_sha256, decoded_sha256)."""
    return trips.select(
        "doc_id",
        *more,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
