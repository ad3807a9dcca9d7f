"""Token counts from a tokenizer compiled into a counting transducer.

The tokenizer is a piece vocabulary with merge scores (sentencepiece BPE with byte fallback). Whether a token may
follow another is decided by those two alone: the pair is allowed if segmenting their joined text gives
the same two tokens, and a segmentation whose neighbours are all allowed is the tokenizer's own. So the last token of each
prefix of a text follows from the last tokens of the prefixes a few characters shorter: a finite state, reached
deterministically. States are built as texts need them; a transition carries the change in the number of emitted tokens.

No piece has a space after another character, so the state forgets everything at each space that follows a
non-space. A chunk's state map is therefore (text before its first such place, tokens from there to its last one, text
after that). Maps compose associatively; the maps of long texts are composed level by level, 64 neighbours at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import write_down

CHUNK_CHARS = 1 << 16
FAN_IN = 64
MAX_STATES = 160_000
MAX_WORDS = 500_000
SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_FORGETS = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class _State(dict):
    """Transitions by character. ``ends``: for each length of the suffix that a later token may begin with, the
    token before that suffix and the tokens counted up to it, less those counted in all."""

    __slots__ = ("suffix", "ends", "machine", "final")

    def __missing__(self, char: str) -> tuple[_State, int]:
        made = self[char] = self.machine.step(self, char)
        return made


class CountingTransducer:
    """Counts of one vocabulary: ``scores`` has the mergeable pieces."""

    def __init__(self, scores: dict[str, float]):
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in scores):
            raise ValueError("a piece has a space after another character: states would not forget")
        self.scores = scores
        self.starts = {piece[:n] for piece in scores for n in range(len(piece))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states built so far; counts stay the same, states are built again when needed."""
        self.states: dict[tuple, _State] = {}
        self.pairs.clear()
        self.start = self._state("", ((0, "", 0),))

    def _state(self, suffix: str, ends: tuple) -> _State:
        state = self.states.get((suffix, ends))
        if state is None:
            state = _State()
            state.suffix, state.ends, state.machine, state.final = suffix, ends, self, None
            self.states[suffix, ends] = state
        return state

    def segment(self, text: str) -> list[str]:
        """The pieces of a short text by repeated best merges, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.scores[both], -place) for place, both in enumerate(map("".join, zip(parts, parts[1:]))) if both in self.scores),
                default=None,
            )
            if best is None:
                break
            place = -best[1]
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def _follows(self, before: str, token: str) -> bool:
        if token not in self.whole:
            self.whole[token] = self.segment(token) == [token]
        if not before or not self.whole[token]:
            return self.whole[token]
        if (before, token) not in self.pairs:
            self.pairs[before, token] = self.segment(before + token) == [before, token]
        return self.pairs[before, token]

    def _emit(self, state: _State, char: str) -> tuple[str, int]:
        """The last token after one more character, and the change in the number of tokens."""
        text = state.suffix + char
        size = len(state.suffix)
        for length, before, counted in state.ends:  # longest first
            token = text[size - length :]
            if (token in self.scores or length == 0) and self._follows(before, token):
                break
        return token, counted + (1 if token in self.scores else len(token.encode()))

    def step(self, state: _State, char: str) -> tuple[_State, int]:
        token, change = self._emit(state, char)
        text = state.suffix + char
        suffix = next(text[at:] for at in range(len(text) + 1) if text[at:] in self.starts)
        ends = []
        for length, before, counted in state.ends:
            if length < len(suffix) and (rest := text[len(text) - length - 1 :]) in self.starts:
                # What stands before a space makes no difference to it.
                known = "" if rest[0] == SPACE and not before.endswith(SPACE) else before
                ends.append((length + 1, known, counted - change))
        ends.append((0, token, 0))
        return self._state(suffix, tuple(ends)), change

    def count(self, text: str) -> int:
        """Tokens of an escaped text (spaces already replaced).

        Between two places where the state forgets, the map is one number; it is remembered by word.
        """
        if len(self.states) > MAX_STATES:
            self.reset()
        words, total = self.words, 0
        for word in _WORDS.findall(text):
            known = words.get(word)
            total += self._run(word) if known is None else known
        return total

    def _run(self, word: str) -> int:
        state, total = self.start, 0
        for char in word[:-1]:
            state, change = state[char]
            total += change
        # Most words end differently from how others go on: their last transition needs no state of its own.
        final = state.final
        if final is None:
            final = state.final = {}
        if word[-1] not in final:
            final[word[-1]] = self._emit(state, word[-1])[1]
        total += final[word[-1]]
        if len(self.words) < MAX_WORDS and len(word) < 64:
            self.words[word] = total
        return total

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, tokens between, tail); tokens are None if no place in the chunk forgets what was before."""
        first = _FORGETS.search(text)
        if first is None:
            return text, None, ""
        last = max(text.rfind(SPACE), 0)
        while text[last - 1] == SPACE:  # a run of spaces starts where the state forgets
            last -= 1
        if last <= first.start():
            last = first.start()
        return text[: first.start()], self.count(text[first.start() : last]), text[last:]

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if one[1] is None and two[1] is None:
            return self.chunk_map(one[0] + two[0])
        if one[1] is None:
            head, between, tail = self.chunk_map(one[0] + two[0])
            if between is None:
                return head, two[1], two[2]
            return head, between + self.count(tail) + two[1], two[2]
        if two[1] is None:
            head, between, tail = self.chunk_map(one[2] + two[0])
            if between is None:
                return one[0], one[1], head
            return one[0], one[1] + self.count(head) + between, tail
        return one[0], one[1] + self.count(one[2] + two[0]) + two[1], two[2]

    def total(self, made: tuple) -> int:
        """Tokens of a whole text from its map."""
        head, between, tail = made
        return self.count(head) + (0 if between is None else between + self.count(tail))


@lru_cache(maxsize=2)
def _machine(path: str) -> CountingTransducer:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    rules, trainer = model.normalizer_spec, model.trainer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if trainer.model_type != 2 or not trainer.byte_fallback or rules.precompiled_charsmap or not plain:
        raise ValueError("only BPE models with byte fallback and no normalisation can be compiled")
    if any(piece.type not in (1, 2, 3, 6) for piece in model.pieces):
        raise ValueError("pieces of the user's own are not compiled")
    return CountingTransducer({piece.piece: piece.score for piece in model.pieces if piece.type == 1})


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit).

    Null and empty texts have 0 bytes and 0 tokens; rows with a null key and repeated rows are counted like
    others; an empty table gives an empty one. Columns other than the two named are not read. ``path`` is the
    vocabulary file, which every executor has like the libraries. A run of characters without spaces is composed in one
    piece, so the longest one has to fit into a task; texts otherwise may be of any length.
    """
    kind = docs.schema[key].dataType.simpleString()
    # A row's number only has to hold its chunks together.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / CHUNK_CHARS).cast("int").alias("chunks"),
    )
    fields = f"row long, doc_id {kind}, n_bytes long, chunk int, chunks int, n long, head string, between long, tail string"
    short = rows.where(F.col("chunks") <= 1).select("row", "doc_id", "n_bytes", F.lit(0).alias("chunk"), "chunks", "t")
    cut = F.substring(F.col("t"), F.col("chunk") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
    long = (
        rows.where(F.col("chunks") > 1)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        .select("row", "doc_id", "n_bytes", "chunk", "chunks", cut.alias("t"))
    )

    def run(batches):
        import pyarrow as pa

        machine = _machine(path)
        for batch in batches:
            made = []
            columns = [batch.column(place).to_pylist() for place in (3, 4, 5)]
            for chunk, chunks, piece in zip(*columns):
                piece = piece.replace(" ", SPACE)
                if chunk == 0 and piece:
                    piece = SPACE + piece
                if chunks <= 1:
                    made.append((machine.count(piece), None, None, None))
                else:
                    made.append((None, *machine.chunk_map(piece)))
            new = [
                pa.array([row[place] for row in made], kind)
                for place, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))
            ]
            old = [batch.column(place) for place in range(5)]
            yield pa.RecordBatch.from_arrays(
                old + new, ["row", "doc_id", "n_bytes", "chunk", "chunks", "n", "head", "between", "tail"]
            )

    def combine(frame):
        machine = _machine(path)
        frame = frame.sort_values("chunk")
        maps = [
            (head, None if between != between or between is None else int(between), tail)
            for head, between, tail in zip(frame["head"], frame["between"], frame["tail"])
        ]
        while len(maps) > 1:  # neighbours first, as in a scan
            pairs = [machine.compose(*maps[at : at + 2]) for at in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) & ~1 :]
        out = frame.iloc[:1].copy()
        out["chunk"] //= FAN_IN
        out["chunks"] = (out["chunks"] + FAN_IN - 1) // FAN_IN
        out["head"], out["between"], out["tail"] = [[part] for part in maps[0]]
        out["between"] = out["between"].astype("Int64")
        if int(out["chunks"].iloc[0]) == 1:
            out["n"] = machine.total(maps[0])
        return out

    counted = short.mapInArrow(run, fields)
    # Long texts alone are moved: first by chunk, so that one text's chunks are counted in many places.
    done = counted.select("doc_id", "n_bytes", "n")
    maps = write_down(long.repartition("row", "chunk").mapInArrow(run, fields))
    while (most := maps.agg(F.max("chunks")).first()[0] or 1) > 1:
        level = maps.withColumn("part", F.floor(F.col("chunk") / FAN_IN)).groupBy("row", "part")
        maps = write_down(level.applyInPandas(lambda frame: combine(frame.drop(columns="part")), fields))
        finished = maps.where("chunks = 1")
        done = done.union(finished.select("doc_id", "n_bytes", "n"))
        maps = maps.where("chunks > 1")
        if most <= FAN_IN:
            break
    return done.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
