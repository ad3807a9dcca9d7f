"""Phrase collocations: candidates by the Apriori rule, counted by double-array tries that all text positions walk at once.

A phrase can only be frequent if the phrases inside it are. Words are counted first. Level by level, the positions where both
parts of a phrase (all but its last word, all but its first) are frequent propose it: under a hash of its first part and its last
word, whose sums over all texts bound its count from above. What reaches the bound is a candidate. Frequent parts are recognised
with a bit filter of bounded size, which lets too much through at worst. So no frequent phrase is missed.

Most pairs of frequent words are rare themselves. Before pairs are proposed they are counted by buckets of their hash, one for
some ``LOAD`` words of the corpus; a pair in a bucket below the bound is rare. Tasks pack their sorted buckets by ranges, and
a range is summed in one small array.

The candidates are dealt into shards of at most ``SHARD`` phrases. A shard's phrases make a double-array trie over numbers of words,
which is broadcast; every task turns its texts into arrays of word numbers and moves the states of all positions with
one numpy step per word, and counts the states that end a phrase. Sums over tasks and shards are the counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import write_down
from gaugeworks.llm.parts import pieces_of, strings

LEAST, WORDS, TOP, COVERED = 30, 4, 2000, 80
#: Phrases in one trie.
SHARD = 500_000
#: Phrases whose counts travel together.
BLOCK = 1 << 12
#: Bits of the filter of frequent parts, at most.
FILTER_BITS = 1 << 27
#: Rows that a task keeps before it adds them up.
KEPT = 1 << 19
#: Words of the corpus to a bucket of pairs, buckets to a range, and pairs that a task packs at once.
LOAD, WIDTH, PACKED = 4, 1 << 20, 1 << 21
_SEED = 42
_TURN = 23

_SORT = np.zeros(256, np.uint8)
_SORT[list(b" \t")] = 1
_SORT[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts in order: ``which`` numbers the distinct ones, ``piece`` their pieces."""

    def __init__(self, texts: pa.Array):
        # Line ends part pieces, so texts can lie one after the other.
        data = np.frombuffer(b"\n".join(texts.to_pylist()), np.uint8)
        sort = _SORT[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = sort == 0
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        starts, ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(sort == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        letters = _LOWER[data[inside[1:-1]]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.which, self.distinct = coded.indices.to_numpy(), coded.dictionary

    def together(self, words: int) -> np.ndarray:
        """Positions where so many words of one piece begin."""
        last = len(self.piece) - words + 1
        return np.nonzero(self.piece[:last] == self.piece[words - 1 :])[0] if last > 0 else np.zeros(0, np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        for piece in pieces_of(batch, 1):
            for lang in pc.unique(piece.column(0)).to_pylist():
                yield lang, Words(piece.column(1).filter(pc.equal(piece.column(0), lang)))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))


def _summed(texts: DataFrame, of, key: str, kind: str) -> DataFrame:
    """(lang, key, n): the sums of ``of(lang, words)``'s (keys, counts) over all texts, added up in the tasks first."""

    def run(batches):
        kept, rows = [], 0

        def added():
            names = ["lang", key, "n"]
            table = pa.concat_tables(kept).group_by(names[:2]).aggregate([("n", "sum")])
            return table.select(["lang", key, "n_sum"]).rename_columns(names)

        for lang, words in _by_language(batches):
            keys, counts = of(lang, words)
            if len(keys):
                langs = pa.array([lang], pa.string()).dictionary_encode().take(pa.array(np.zeros(len(keys), np.int32))).cast(pa.string())
                kept.append(pa.table([langs, pa.array(keys), pa.array(counts, pa.int64())], ["lang", key, "n"]))
                rows += len(keys)
            if rows > KEPT:
                kept = [added()]
                rows = kept[0].num_rows
                if rows > KEPT // 2:
                    yield from kept[0].to_batches()
                    kept, rows = [], 0
        if kept:
            yield from added().to_batches()

    return texts.mapInArrow(run, f"lang string, {key} {kind}, n long").groupBy("lang", key).agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words."""

    def of(lang: str, words: Words):
        return words.distinct, np.bincount(words.which, minlength=len(words.distinct))

    return _summed(texts, of, "phrase", "string")


def _hash_of(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    """The same, in Python."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode(), _SEED)
    return np.fromiter((xxh64_intdigest(word, seed) for word in words), np.uint64, len(words))


def _longer(hashes, following):
    """The hash of a phrase and a word after it, for columns or arrays."""
    if isinstance(hashes, Column):
        return F.shiftleft(hashes, _TURN).bitwiseOR(F.shiftrightunsigned(hashes, 64 - _TURN)).bitwiseXOR(following)
    return (hashes << np.uint64(_TURN) | hashes >> np.uint64(64 - _TURN)) ^ following


class Filter:
    """Tells which hashes may be among those it was made of: three bits each in an array of at most ``FILTER_BITS``."""

    def __init__(self, hashes: DataFrame, most: int = FILTER_BITS):
        count = hashes.count()
        self.bits = min(most, 1 << max(10, math.ceil(math.log2(16 * count + 1))))
        places = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("h", shift), F.lit(self.bits)) for shift in (0, 18, 36)]))
        rows = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 5).alias("at"))
        # Four bytes to a row, so rows are bounded by the array and no sign is in the way.
        made = rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("set")).toArrow()
        self.words = np.zeros(self.bits // 32, np.uint32)
        self.words[made["at"].to_numpy()] = made["set"].to_numpy().astype(np.uint32)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in (0, 18, 36):
            places = (hashes >> np.uint64(shift)) & np.uint64(self.bits - 1)
            found &= (self.words[(places >> np.uint64(5)).astype(np.int64)] >> (places & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return found


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Unsigned numbers stirred so that all their bits are as good as any."""
    numbers = (numbers ^ numbers >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ numbers >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return numbers ^ numbers >> np.uint64(31)


def _pairs(lang: str, words: Words, words_known: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of pairs of frequent words, their hashes, hashes of all words)."""
    at = words.together(2)
    single = _hashes(lang, strings(words.distinct))
    frequent, hashes = words_known.holds(single)[words.which], single[words.which]
    at = at[frequent[at] & frequent[at + 1]]
    return at, _longer(hashes[at], hashes[at + 1]), hashes


def _packed(buckets: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """(range, its buckets and counts in few bytes); counts beyond ``most`` are as good as it."""
    from zstandard import ZstdCompressor

    buckets, counts = np.unique(buckets, return_counts=True)
    ranges = (buckets // np.uint64(WIDTH)).astype(np.int64)
    starts = np.concatenate([[0], np.nonzero(np.diff(ranges))[0] + 1, [len(ranges)]]).tolist()
    for start, end in zip(starts, starts[1:]):
        places = (buckets[start:end] % np.uint64(WIDTH)).astype(np.int64)
        steps = np.diff(places, prepend=0).astype("<u4")
        # Bytes of the same weight lie together, as the upper ones are nearly all zero.
        planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
        data = planes + np.minimum(counts[start:end], most).astype("<u4").tobytes()
        yield int(ranges[start]), ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    steps, counts = np.split(raw, 2)
    steps = np.ascontiguousarray(steps.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64), counts.view("<u4")


def heavy_buckets(texts: DataFrame, buckets: int, words_known: Filter, least: int) -> DataFrame:
    """(h): the buckets, stirred, in which pairs of frequent words occur ``least`` times together; ``buckets`` is a power of two."""
    sent = texts.sparkSession.sparkContext.broadcast(words_known)

    def run(batches):
        kept, size = [], 0

        def made():
            number, data = zip(*_packed(np.concatenate(kept), least))
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["range", "data"])

        for lang, words in _by_language(batches):
            _, pairs, _ = _pairs(lang, words, sent.value)
            kept.append(_mixed(pairs) & np.uint64(buckets - 1))
            size += len(pairs)
            if size > PACKED:
                yield made()
                kept, size = [], 0
        if size:
            yield made()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(WIDTH, np.int64)
        for data in table["data"]:
            places, counts = _unpacked(data.as_py())
            total[places] += counts
        found = np.nonzero(total >= least)[0] + table["range"][0].as_py() * WIDTH
        return pa.table([pa.array(_mixed(found.astype(np.uint64)).view(np.int64))], ["h"])

    return texts.mapInArrow(run, "range long, data binary").groupBy("range").applyInArrow(add, "h long")


def proposals(texts: DataFrame, length: int, known: Filter, words_known: Filter, buckets: int, least: int) -> DataFrame:
    """(lang, key, n): phrases of ``length`` words whose parts may be frequent, by a hash, that occur ``least`` times or more.

    The upper half of the key is that of all but the last word's hash, the lower half that of the last word. ``known`` has the
    frequent phrases one word shorter; for pairs it has the heavy ones of so many ``buckets``. Tasks send their sorted keys and
    counts as arrays, one per language and range of keys; there are as many ranges as the corpus asks for.
    """
    sent, words_sent = (texts.sparkSession.sparkContext.broadcast(one) for one in (known, words_known))
    half = np.uint64(32)

    def of(lang: str, words: Words):
        if length == 2:
            at, pairs, hashes = _pairs(lang, words, words_sent.value)
            at = at[sent.value.holds(_mixed(_mixed(pairs) & np.uint64(buckets - 1)))]
            keys, counts = np.unique((hashes[at] >> half << half) | hashes[at + 1] >> half, return_counts=True)
            return keys.view(np.int64), counts
        at = words.together(length)
        single = _hashes(lang, strings(words.distinct))
        fine = words_sent.value.holds(single)
        frequent = fine[words.which]
        ok = frequent[at]
        for step in range(1, length):
            ok &= frequent[at + step]
        at = at[ok]
        hashes = single[words.which]
        first, second = hashes[at], hashes[at + 1]
        for step in range(1, length - 1):
            first, second = _longer(first, hashes[at + step]), _longer(second, hashes[at + step + 1])
        ok = sent.value.holds(first) & sent.value.holds(second)
        at, first = at[ok], first[ok]
        keys = (first >> half << half) | hashes[at + length - 1] >> half
        keys, counts = np.unique(keys, return_counts=True)
        return keys.view(np.int64), counts

    bits = max(0, (buckets // WIDTH).bit_length() - 1)

    def run(batches):
        from zstandard import ZstdCompressor

        kept, size, pressed = defaultdict(list), 0, ZstdCompressor(level=1)

        def made():
            rows = []
            for lang, parts in kept.items():
                keys, counts = _added(*map(np.concatenate, zip(*parts)))
                ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                starts = np.concatenate([[0], np.nonzero(np.diff(ranges))[0] + 1, [len(keys)]]).tolist()
                rows += [(lang, int(ranges[a]), pressed.compress(keys[a:b].tobytes() + counts[a:b].tobytes())) for a, b in zip(starts, starts[1:])]
            langs, numbers, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["lang", "range", "data"])

        for lang, words in _by_language(batches):
            keys, counts = of(lang, words)
            if len(keys):
                kept[lang].append((keys.view(np.uint64), counts.astype(np.int64)))
                size += len(keys)
            if size > KEPT:
                yield made()
                kept, size = defaultdict(list), 0
        if size:
            yield made()

    def add(table: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        raw = [np.frombuffer(ZstdDecompressor().decompress(data.as_py()), np.uint64) for data in table["data"]]
        halves = [np.split(one, 2) for one in raw]
        keys, counts = _added(*map(np.concatenate, zip(*halves)))
        often = counts >= least
        lang = pa.array([table["lang"][0].as_py()] * int(often.sum()), pa.string())
        return pa.table([lang, pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["lang", "key", "n"])

    packed = texts.mapInArrow(run, "lang string, range long, data binary")
    return packed.groupBy("lang", "range").applyInArrow(add, "lang string, key long, n long")


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def candidates(texts: DataFrame, singles: DataFrame, total: int, least: int = LEAST, longest: int = WORDS) -> list[DataFrame]:
    """(lang, phrase, h) of the phrases of 2, 3 and so on words that can occur ``least`` times; ``singles`` has frequent words,
    ``total`` is the number of words of all texts."""
    words = write_down(singles.select("lang", "phrase", _hash_of(F.col("lang"), F.col("phrase")).alias("h")))
    words_known = Filter(words.select("h"))
    buckets = max(WIDTH, 1 << math.ceil(math.log2(total / LOAD + 1)))
    known = Filter(write_down(heavy_buckets(texts, buckets, words_known, least)))
    last, found = words, []
    lower = words.select(F.col("lang").alias("wl"), F.col("phrase").alias("word"), F.col("h").alias("wh"), F.shiftrightunsigned("h", 32).alias("w32"))
    for length in range(2, longest + 1):
        often = proposals(texts, length, known, words_known, buckets, least)
        halves = often.select("lang", F.shiftrightunsigned("key", 32).alias("p32"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("w32"))
        upper = last.select(F.col("lang").alias("pl"), F.col("phrase").alias("start"), F.col("h").alias("ph"), F.shiftrightunsigned("h", 32).alias("u32"))
        both = halves.join(upper, (F.col("lang") == F.col("pl")) & (F.col("p32") == F.col("u32")))
        both = both.join(lower, (both["lang"] == lower["wl"]) & (both["w32"] == lower["w32"]))
        last = write_down(both.select("lang", F.concat_ws(" ", "start", "word").alias("phrase"), _longer(F.col("ph"), F.col("wh")).alias("h")).distinct())
        found.append(last)
        if length < longest:
            known = Filter(last.select("h"))
    return found


class Trie:
    """A double-array trie over phrases as tuples of word numbers from 1 on: state t follows s by word c if t = base[s] + c and
    check[t] = s. ``ends`` has the place of the phrase that a state ends, or -1."""

    def __init__(self, phrases: list[tuple[int, ...]], words: int):
        follow: list[dict[int, int]] = [{}]  # a plain trie first
        ends_at = {}
        for place, phrase in enumerate(phrases):
            node = 0
            for word in phrase:
                after = follow[node].get(word)
                if after is None:
                    after = follow[node][word] = len(follow)
                    follow.append({})
                node = after
            ends_at[node] = place
        bases, taken = self._fitted(follow, words)
        self.base, self.check, self.ends = (np.full(len(taken), least, np.int32) for least in (0, -1, -1))
        state = np.zeros(len(follow), np.int64)
        # Nodes come in the order they were made, so a state is known before its followers.
        for node, after in enumerate(follow):
            if after:
                here, base = state[node], bases[node]
                self.base[here] = base
                for word, target in after.items():
                    self.check[base + word] = here
                    state[target] = base + word
        for node, place in ends_at.items():
            self.ends[state[node]] = place
        self.longest = max(map(len, phrases), default=0)

    @staticmethod
    def _fitted(follow: list[dict[int, int]], words: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(base of each node, places taken). The root's followers have places by number; the other nodes fill what is free behind
        them, those with most followers first, and single followers what is then left over."""
        bases, total = np.zeros(len(follow), np.int64), len(follow)
        taken = np.zeros(words + 1 + 2 * total + words + block, bool)
        taken[: words + 1] = True
        wide = sorted((node for node in range(1, total) if len(follow[node]) > 1), key=lambda node: -len(follow[node]))
        first = words + 1  # where the least follower may lie; what is before is nearly full
        for node in wide:
            after = np.sort(np.fromiter(follow[node], np.int64, len(follow[node])))
            steps, at = after - after[0], first
            while True:
                if at + block + words >= len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                fitting = at + np.nonzero(~taken[at : at + block])[0]
                for step in steps[1:]:
                    fitting = fitting[~taken[fitting + step]]
                    if not len(fitting):
                        break
                if len(fitting):
                    break
                at += block
            taken[fitting[0] + steps] = True
            bases[node] = fitting[0] - after[0]
            # Blocks that long had no room are left to the single followers.
            first = max(first, at - 2 * block)
            if taken[first : first + block].mean() > 0.7:
                first += block
        single = np.array([node for node in range(1, total) if len(follow[node]) == 1], np.int64)
        free = np.nonzero(~taken)[0]
        while len(free) < len(single):
            taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            free = np.nonzero(~taken)[0]
        free = free[: len(single)]
        bases[single] = free - np.array([next(iter(follow[node])) for node in single.tolist()], np.int64)
        taken[free] = True
        # Room for every word after every base, so that a look-up is never outside.
        return bases, np.zeros(int(max(np.nonzero(taken)[0][-1], bases.max())) + words + 2, bool)

    def count(self, numbers: np.ndarray, piece: np.ndarray, into: np.ndarray) -> None:
        """Add how often each phrase occurs in a row of words; ``numbers`` has 0 for words that no phrase has."""
        at = np.nonzero(numbers)[0]
        state = numbers[at].astype(np.int64)
        held = self.check[state] == 0
        at, state = at[held], state[held]
        for step in range(self.longest):
            reached = self.ends[state]
            into += np.bincount(reached[reached >= 0], minlength=len(into))
            inside = at + step + 1 < len(numbers)
            at, state = at[inside], state[inside]
            there = at + step + 1
            after = self.base[state] + numbers[there]
            held = (numbers[there] > 0) & (piece[there] == piece[at]) & (self.check[after] == state)
            at, state = at[held], after[held].astype(np.int64)


def _added_blocks(table: pa.Table) -> pa.Table:
    """(place, n) of one block of phrases, from all tasks' arrays of it."""
    from zstandard import ZstdDecompressor

    total = None
    for data in table["data"]:
        counts = np.frombuffer(ZstdDecompressor().decompress(data.as_py()), np.int64)
        total = counts.copy() if total is None else total + counts
    place = np.nonzero(total)[0]
    return pa.table([pa.array(place + table["block"][0].as_py() * BLOCK), pa.array(total[place])], ["place", "n"])


def count_phrases(texts: DataFrame, phrases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n): how often each of ``phrases`` (lang, phrase) of two or more words occurs within pieces."""
    spark = texts.sparkSession
    total = phrases.count()
    shards = max(1, math.ceil(total / shard))
    # A little over an even share each; the first word decides, so a shard's trie shares beginnings.
    dealt = write_down(phrases.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).alias("shard")))
    results = []
    for number in range(shards):
        listed = dealt.where(F.col("shard") == number).select("lang", "phrase").toArrow()
        ids: dict[str, dict[str, int]] = {}
        coded, words = [], 0
        for lang, phrase in zip(listed["lang"].to_pylist(), listed["phrase"].to_pylist()):
            mine, numbers = ids.setdefault(lang, {}), []
            for word in phrase.split(" "):
                if word not in mine:
                    words += 1
                    mine[word] = words
                numbers.append(mine[word])
            coded.append(tuple(numbers))
        if not coded:
            continue
        sent = spark.sparkContext.broadcast((Trie(coded, words), ids, len(coded)))
        places = spark.createDataFrame(listed.append_column("place", pa.array(np.arange(len(coded)))))

        def run(batches, sent=sent):
            from zstandard import ZstdCompressor

            trie, ids, size = sent.value
            counts = np.zeros(size, np.int64)
            for lang, words in _by_language(batches):
                known = ids.get(lang, {})
                numbers = np.fromiter((known.get(word, 0) for word in strings(words.distinct)), np.int32, len(words.distinct))
                trie.count(numbers[words.which], words.piece, counts)
            # A task's counts go as a few arrays, not as a row per phrase.
            pressed = ZstdCompressor(level=1)
            blocks = [(at // BLOCK, pressed.compress(counts[at : at + BLOCK].tobytes())) for at in range(0, size, BLOCK) if counts[at : at + BLOCK].any()]
            if blocks:
                numbers, data = zip(*blocks)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

        counted = texts.mapInArrow(run, "block long, data binary").groupBy("block").applyInArrow(_added_blocks, "place long, n long")
        results.append(write_down(counted.join(places, "place").select("lang", "phrase", "n")))
    if not results:
        return spark.createDataFrame([], "lang string, phrase string, n long")
    whole = results[0]
    for more in results[1:]:
        whole = whole.union(more)
    return whole


def scored(counts: DataFrame, totals: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from ``counts`` (lang, phrase, a) of frequent phrases of one word and more."""
    wide = F.split("phrase", " ")
    whole = counts.select("lang", "phrase", "a", wide.alias("w"), F.size(wide).alias("k")).where("k > 1")

    def part(first: Column, length: Column) -> Column:
        return F.array_join(F.slice("w", first, length), " ")

    cuts = whole.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    one = counts.select(F.col("lang").alias("ll"), F.col("phrase").alias("lp"), F.col("a").alias("l"))
    two = counts.select(F.col("lang").alias("rl"), F.col("phrase").alias("rp"), F.col("a").alias("r"))
    joined = cuts.join(one, (cuts["lang"] == one["ll"]) & (cuts["left"] == one["lp"]))
    joined = joined.join(two, (joined["lang"] == two["rl"]) & (joined["right"] == two["rp"]))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m")
    judged = joined.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # Phrases inside longer ones that make up most of their occurrences go.
    inner = whole.where("k > 2").select("lang", "a", "w", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("from"))
    longer = inner.select(F.col("lang").alias("il"), part(F.col("from"), F.col("size")).alias("ip"), "a").groupBy("il", "ip").agg(F.max("a").alias("longer"))
    kept = judged.join(longer, (judged["lang"] == longer["il"]) & (judged["phrase"] == longer["ip"]), "left")
    wide_a, wide_longer = (F.col(name).cast("decimal(19, 0)") for name in ("a", "longer"))
    kept = kept.where(F.col("longer").isNull() | (wide_longer * 100 < wide_a * covered))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.select("lang", "phrase", "a", "l", "r", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language by how strongly their words belong together.

    One row per phrase: (lang, rank, phrase, a, l, r, n, score). Null texts are empty, null languages ``und``. Repeated rows count
    each time; ties go by count, then by phrase; texts of any length are read whole; an empty table, or one
    without frequent phrases, gives an empty one. Columns other than the two named are not read.
    """
    texts = _texts(docs, text, lang)
    words = write_down(count_words(texts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = words.where(F.col("n") >= least)
    size = words.agg(F.sum("n")).first()[0] or 0
    found = candidates(texts, singles.select("lang", "phrase"), size, least)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    counted = count_phrases(texts, every.select("lang", "phrase"), shard).where(F.col("n") >= least)
    counts = singles.union(counted).withColumnRenamed("n", "a")
    return scored(counts, totals, top)


def oracle(least: int = LEAST, top: int = TOP, covered: int = COVERED) -> str:
    """The same in SQL for DuckDB."""
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
rows AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
spread AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM rows, range(1, 5) AS sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM spread GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE a >= {least}),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS lp, array_to_string(list_slice(w, cut + 1, k), ' ') AS rp
  FROM often, range(1, 4) AS places(cut) WHERE cut < k),
judged AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score, cut
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.lp JOIN often y ON y.lang = c.lang AND y.phrase = c.rp),
lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(list_slice(w, f, f + s - 1), ' ') AS phrase
  FROM often, range(2, 4) AS sizes(s), range(1, 4) AS firsts(f) WHERE k > 2 AND s < k AND f + s - 1 <= k),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer m ON m.lang = c.lang AND m.phrase = c.phrase
  WHERE m.a IS NULL OR 100 * m.a < {covered} * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {top}"""
