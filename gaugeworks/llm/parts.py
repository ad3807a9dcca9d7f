"""Token ids of many texts at once: each distinct part between blanks is encoded once, and Arrow and numpy put the ids together.

Most words of a text have been seen before. A batch is cut at its blanks and dictionary-encoded by Arrow, so Python meets every
distinct part of a batch once. What was encoded is remembered in two generations: when the younger one is full it becomes the
older one, and what the older one still knows is taken over when it is met again. The memory thus never stops learning and never
holds more than two generations.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 250_000
#: Longer parts are encoded anew each time.
LONGEST = 64
#: Bytes of text that are cut at once.
PIECE_BYTES = 8 << 20
#: Characters that are white space by Unicode or by Python.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class PartEncoder:
    """Encodes texts through ``encode_parts(list of parts) -> list of ids as little-endian unsigned 32-bit bytes``.

    With ``blank_leads`` a blank between two visible characters belongs to the part after it, as in byte-level vocabularies;
    otherwise blanks belong to no part.
    """

    def __init__(self, encode_parts: Callable[[list[str]], list[bytes]], blank_leads: bool = False, generation: int = GENERATION):
        self.encode_parts, self.blank_leads, self.generation = encode_parts, blank_leads, generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        young, old = self.young, self.old
        found = [young.get(part) for part in parts]
        new = []
        for place, ids in enumerate(found):
            if ids is None:
                part = parts[place]
                ids = old.get(part)
                if ids is None:
                    new.append(place)
                else:
                    found[place] = young[part] = ids
        for place, ids in zip(new, self.encode_parts([parts[place] for place in new])):
            found[place] = ids
            if len(parts[place]) < LONGEST:
                young[parts[place]] = ids
        if len(young) >= self.generation:
            self.young, self.old = {}, young
        return found

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts of all texts, number of parts of each)."""
        cut = pc.split_pattern(texts, " ")
        sizes = np.diff(cut.offsets.to_numpy())
        if not self.blank_leads:
            return cut.flatten(), sizes
        # A blank next to white space is no safe place; such texts are cut one by one.
        spaced = pc.match_substring_regex(texts, f"^{_WHITE}|{_WHITE}$|{_WHITE} | {_WHITE}")
        parts, counts = [], sizes.copy()
        flat, starts = cut.flatten(), cut.offsets.to_numpy()
        last = 0
        for row in np.nonzero(spaced.to_numpy(zero_copy_only=False))[0]:
            pieces = _SAFE_BLANK.split(texts[int(row)].as_py())
            parts += [flat[last : starts[row]], pa.array(pieces, pa.string())]
            counts[row], last = len(pieces), starts[row + 1]
        parts.append(flat[last:])
        return pa.concat_arrays(parts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        parts, sizes = self._cut(texts)
        coded = parts.dictionary_encode()
        which, words = coded.indices.to_numpy(), strings(coded.dictionary)
        if self.blank_leads:
            # No blank leads the first part of a text.
            places = np.cumsum(sizes) - sizes
            first = parts.take(pa.array(places)).dictionary_encode()
            which = which.copy()
            which[places] = first.indices.to_numpy() + len(words)
            known = self._known([" " + word for word in words]) + self._known(strings(first.dictionary))
        else:
            known = self._known(words)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        every = np.frombuffer(b"".join(known), "<u4")
        counts = lengths[which]
        ends = np.cumsum(counts)
        # The ids of a part lie in a row: its start, and on from there.
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 and len(every) < 1 << 31 else np.int64
        places = np.repeat((starts[which] - (ends - counts)).astype(kind), counts)
        places += np.arange(len(places), dtype=kind)
        before = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return every[places], before[bounds[1:]] - before[bounds[:-1]]


def strings(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls; by way of numpy this is several times faster than one by one."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def pieces_of(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``most`` bytes of text, of one row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end
    # Arrow keeps for later what a batch took; the executor needs it now.
    pa.default_memory_pool().release_unused()


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary per text: its ids as little-endian unsigned 32-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum(4 * counts)])
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), data]).cast(pa.binary())


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    stands = {byte: chr(byte) for byte in printable} | {byte: chr(256 + n) for n, byte in enumerate(others)}
    return [stands[byte] for byte in range(256)]


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def library_encoder(path: str, blank_leads: bool) -> PartEncoder:
    """An encoder by the tokenizers library; raises if the file's words do not end where the parts do."""
    from tokenizers import Tokenizer

    # A task has one core; threads for all of the machine's would each keep memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    steps = str(library.normalizer) + str(library.pre_tokenizer)
    ends = "add_prefix_space=False" in steps and "use_regex=True" in steps and library.normalizer is None
    if not (ends if blank_leads else "Replace" in steps and "invert=True" in steps):
        raise ValueError("words of this vocabulary file do not end at blanks")

    tokenize, stands = library.model.tokenize, dict(enumerate(byte_characters()))
    # Such a part is a word of the file's pattern, perhaps a sign and the next line's first word; composed and lower case as they
    # should be, so the library's model can be asked without its normalizer and splitter.
    word, sign = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "([.,;:!?]?)"
    plain = re.compile(f"({' ?' if blank_leads else ''}{word}){sign}(?:(\n)({word}){sign})?").fullmatch
    signs = {part: _packed(library.encode(part, add_special_tokens=False).ids) for part in ("", "\n", *".,;:!?")}

    def ids_of(word: str) -> bytes:
        if not blank_leads:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(stands)
        elif blank_leads:
            word = word.replace(" ", stands[32])
        ids = [token.id for token in tokenize(word)]
        return pack(f"<{len(ids)}I", *ids)

    def encode_parts(parts: list[str]) -> list[bytes]:
        found, others = [], []
        for place, part in enumerate(parts):
            match = plain(part)
            if match is None:
                others.append(place)
                found.append(b"")
                continue
            word, sign, line, following, last = match.groups()
            ids = ids_of(word) + signs[sign] if sign else ids_of(word)
            found.append(ids + signs[line] + ids_of(following) + signs[last] if line else ids)
        made = library.encode_batch_fast([parts[place] for place in others], add_special_tokens=False)
        for place, one in zip(others, made):
            found[place] = _packed(one.ids)
        return found

    return PartEncoder(encode_parts, blank_leads)
