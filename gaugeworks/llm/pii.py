"""Personal data: the base rules, and spans that a trained character model adds to them.

The model learns from labelled spans: those the rules find in a bounded sample of the documents, and written variants of them
that the rules do not know (numbers with other separators, spelled-out at signs) put among the sample's own words, with
look-alikes that are none. Base spans always stay. A span of the model is added if it is certain enough, has the make-up of
its kind and touches neither a base span nor a match that the rule of its kind has refused.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import pii_model, pii_rules
from gaugeworks.llm.common import per_text
from gaugeworks.llm.pii_rules import KINDS

SAMPLE_DOCS = 400
WINDOWS = 1500
ROUNDS = 8
CERTAIN = 0.9
#: Replaces a span in ``redact``.
MARKS = {kind: f"[{kind.upper()}]" for kind in KINDS}
_DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (14, 19), "phone": (7, 15)}


def _invented(random: np.random.Generator) -> list[tuple[str, str | None]]:
    """One written example of each sort, with its kind; None for look-alikes."""

    def digits(n: int) -> str:
        return "".join(map(str, random.integers(0, 10, n)))

    def letters(n: int) -> str:
        return "".join(chr(97 + c) for c in random.integers(0, 26, n))

    name, host = f"{letters(random.integers(3, 8))}.{digits(2)}", f"{letters(random.integers(3, 7))}{digits(1)}.{letters(3)}"
    plain = f"{letters(random.integers(3, 12))}.{letters(random.integers(3, 12))}"
    place = ["", f"{letters(random.integers(3, 9))}-"][random.integers(2)] + letters(random.integers(3, 10)) + ["", digits(2)][random.integers(2)]
    short, host_only = f"{letters(random.integers(3, 7))}.{letters(random.integers(2, 7))}", f"{letters(random.integers(4, 9))}"
    place += "." + ["com", "org", "net", letters(2), letters(3)][random.integers(5)]
    parts = [str(n) for n in random.integers(1, 255, 4)]
    fours = [digits(4) for _ in range(4)]
    number = [digits(3), digits(3), digits(4)]
    return [
        (f"{name}@{host}.com", "email"),
        (f"{name} (at) {host}.com", "email"),
        (f"{name}[at]{host}.com", "email"),
        (f"{plain} (at) {place}", "email"),
        (f"{plain}[at]{place}", "email"),
        (f"{plain} (at) {letters(random.integers(4, 9))}-{letters(random.integers(3, 8))}{digits(2)}.com", "email"),
        (f"{plain} (at) {letters(random.integers(4, 9))}-{letters(random.integers(3, 8))}.{letters(3)}", "email"),
        (f"{short} (at) {host_only}.com", "email"),
        (f"{short}[at]{host_only}.org", "email"),
        (f"{plain} at {letters(random.integers(2, 8))}. {letters(random.integers(2, 6)).title()}", None),
        (f"at {letters(random.integers(2, 8))}. At {letters(random.integers(2, 6))} (at {letters(random.integers(2, 8))}).", None),
        (".".join(parts), "ip"),
        ("[.]".join(parts), "ip"),
        ("".join(fours), "card"),
        (" ".join(fours), "card"),
        (".".join(fours), "card"),
        (f"+1 ({number[0]}) {number[1]}-{number[2]}", "phone"),
        (f"({number[0]}) {number[1]}-{number[2]}", "phone"),
        (".".join(number), "phone"),
        (f"password={random.bytes(9).hex()}", None),
        (f'token = "{random.bytes(20).hex()}"', None),
        ("AKIA" + letters(8).upper() + digits(4) + letters(4).upper(), None),
        (f"version {digits(1)}.{digits(1)}.{digits(1)}", None),
        (f"20{digits(2)}-0{random.integers(1, 10)}-1{digits(1)}", None),
        (f"BY-NC {digits(1)}.{digits(1)}", None),
        (digits(int(random.integers(1, 9))), None),
        (f"{digits(2)},{digits(3)}.{digits(2)}", None),
        (f"#{digits(5)}", None),
    ]


def _labelled(texts: list[str], windows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and their tags."""
    random = np.random.default_rng(seed)
    ids = np.zeros((windows, pii_model.WINDOW), np.int64)
    tags = np.zeros((windows, pii_model.WINDOW), np.int64)
    words = [word for text in texts for word in text.split() if not pii_rules.may_hold_any(word)] or ["and", "the"]
    examples: list[tuple[str, str | None]] = []
    real = [(text, spans) for text in texts if (spans := pii_rules.candidates(text))]
    for row in range(windows):
        marks: list[tuple[int, int, str]] = []
        if real and row % 3 == 0:
            text, found = real[random.integers(len(real))]
            start, end, _, _ = found[random.integers(len(found))]
            left = max(0, start - int(random.integers(0, pii_model.WINDOW)))
            line = text[left : left + pii_model.WINDOW]
            # A refused match is no personal data; it is left unlabelled.
            marks = [(s - left, e - left, kind) for s, e, kind, fine in found if fine and e > left and s < left + pii_model.WINDOW]
        else:
            line = ""
            if not examples:
                examples = _invented(random)
                random.shuffle(examples)
            shown, kind = examples.pop()
            for _ in range(random.integers(0, 6)):
                line += words[random.integers(len(words))] + " "
            start = len(line)
            line += str(shown)
            if kind:
                marks.append((start, len(line), kind))
            while len(line) < 2 * pii_model.WINDOW:
                line += " " + words[random.integers(len(words))]
            left = int(random.integers(0, max(1, min(start + 8, pii_model.WINDOW))))
            line, marks = line[left : left + pii_model.WINDOW], [(s - left, e - left, kind) for s, e, kind in marks]
        numbers = pii_model.ids_of(line)
        ids[row, : len(numbers)] = numbers
        for start, end, kind in marks:
            begin = 1 + 2 * KINDS.index(kind)
            tags[row, max(start, 0) : max(end, 0)] = begin + 1
            # A span that the window cuts begins where the window does.
            if max(start, 0) < pii_model.WINDOW and end > 0:
                tags[row, max(start, 0)] = begin
    return ids, tags


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS, windows: int = WINDOWS, rounds: int = ROUNDS) -> dict:
    """Train on ``windows`` windows from at most ``sample`` different documents that hold a digit or an at sign, chosen by a hash
    of their text; of each, 4,000 characters around its first sign are learned from. Without any document the written variants alone teach."""
    sign = F.regexp_instr(F.col(text), F.lit("[0-9@]"))
    around = F.substring(F.col(text), F.greatest(sign - 1000, F.lit(1)), F.lit(4000))
    some = docs.where(sign > 0).select(around.alias("t")).withColumn("h", F.xxhash64("t"))
    # Few rows pass the bound on their hash, some four times as many as are asked for, so no partition sends many.
    different = some.agg(F.approx_count_distinct("h")).first()[0]
    bound = -(1 << 63) + min((1 << 64) - 1, 4 * sample * (1 << 64) // max(different, 1))
    chosen = some.where(F.col("h") <= bound).distinct().orderBy("h", "t").limit(sample).select("t")
    # One task trains, on the bounded sample; a row of its own makes sure that there is one.
    one = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("t"))

    def train(batches):
        import pyarrow as pa

        texts = sorted(t for batch in batches for t in batch.column(0).to_pylist() if t is not None)
        made = pii_model.train(*_labelled(texts, windows), rounds)
        yield pa.RecordBatch.from_pydict({"name": list(made), "shape": [list(v.shape) for v in made.values()], "data": [v.tobytes() for v in made.values()]})

    rows = chosen.union(one).coalesce(1).mapInArrow(train, "name string, shape array<long>, data binary").collect()
    return {row["name"]: np.frombuffer(bytes(row["data"]), np.float32).reshape(row["shape"]) for row in rows}


def _fits(text: str, kind: str) -> bool:
    digits = sum(c.isdigit() for c in text)
    least, most = _DIGITS[kind]
    return least <= digits <= most and (kind != "email" or (pii_model.SPELLED.search(text) is not None and "." in text))


def spans_of(texts: list[str], parameters: dict) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, end, kind)."""
    seen = [pii_rules.candidates(text) for text in texts]
    asked = [n for n, text in enumerate(texts) if pii_rules.may_hold_any(text) or pii_model.SPELLED.search(text)]
    found = dict(zip(asked, pii_model.decode(parameters, [texts[n] for n in asked])))
    out = []
    for n, text in enumerate(texts):
        taken = [(start, end, None if fine else kind) for start, end, kind, fine in seen[n]]
        added = []
        for start, end, kind, certainty in found.get(n, ()):
            while end > start and text[end - 1].isspace():
                end -= 1
            # A base span is whole as it is; a match refused by a rule is refused for that kind.
            free = all(end <= s or start >= e for s, e, refused in taken if refused in (None, kind))
            if certainty >= CERTAIN and free and _fits(text[start:end], kind):
                added.append((start, end, kind))
        out.append(([(s, e, kind) for s, e, kind, fine in seen[n] if fine], added))
    return out


def find(docs: DataFrame, parameters: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, base, added), both lists of (start, stop, kind) in code points.

    Null and empty texts have no spans; null keys and repeated rows pass through; an empty table gives an empty one. Texts of
    any length are read whole. Columns other than the two named are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<start:int,stop:int,kind:string>>"

    def rows(keys: list, texts: list) -> dict:
        both = spans_of([(t or b"").decode() for t in texts], parameters)
        as_rows = [[[{"start": s, "stop": e, "kind": k} for s, e, k in part] for part in pair] for pair in both]
        return {"doc_id": keys, "base": [pair[0] for pair in as_rows], "added": [pair[1] for pair in as_rows]}

    return per_text(docs, key, text, f"doc_id {kind}, base {span}, added {span}", rows)


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find``: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added). The four counts are of base
    spans, as is the digest; ``spans`` has all."""

    def joined(spans):
        # By start, then kind in its order, then end.
        order = F.array(*[F.lit(kind) for kind in KINDS])
        keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("place"), s["stop"], s["kind"]))
        written = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(written, ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a mark in place of each span; of overlapping spans the first names the mark and all go."""
    parts, at = [], 0
    for start, end, kind in sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]))):
        if start >= at:
            parts += [text[at:start], MARKS[kind]]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, parameters: dict, text: str = "text") -> DataFrame:
    """``docs`` with the spans in its texts replaced by marks; all columns and rows stay, null texts stay null."""

    @F.arrow_udf(docs.schema[text].dataType)
    def marked(texts):
        import pyarrow as pa

        texts = texts.to_pylist()
        spans = spans_of([t or "" for t in texts], parameters)
        return pa.array([t if t is None else redact_text(t, a + b) for t, (a, b) in zip(texts, spans)], pa.string())

    return docs.withColumn(text, marked(text))
