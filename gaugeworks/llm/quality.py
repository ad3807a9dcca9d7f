"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Every text becomes a few statistics of its whole length (``FEATURES``). Random Fourier features of the standardised
statistics approximate a Gaussian kernel. Each partition adds up its part of the normal equations, one per fold; their sums
are small whatever the number of rows. Ridge regression is solved four times without one fold each, so that every training
row has a score of a model that did not see it; binned by score, these rows give the isotonic calibration. The
final model is solved from all folds. All labelled training rows take part; there is no sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import per_text, rows_with, write_down

FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "line_ends", "sentence_marks", "exclamations",
    "bars", "symbols", "other_bytes", "entropy", "word_length", "word_spread", "distinct_words", "top_word",
    "distinct_pairs", "same_as_before", "odd_ends", "capital_starts", "distinct_lines", "line_length",
)
RANDOM_FEATURES = 192
FOLDS = 4
RIDGE = 1.0
BINS = 1000
THRESHOLD = 0.7
SEED = 20
_SYMBOLS = np.frombuffer(b"#$%&*@~^=+<>{}[]\\_`", dtype=np.uint8)
_AT_A_TIME = 1 << 20


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one UTF-8 text, all 0 for null and empty ones."""
    if not text:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts = np.zeros(256, dtype=np.int64)
    for start in range(0, size, _AT_A_TIME):
        counts += np.bincount(np.frombuffer(text[start : start + _AT_A_TIME], dtype=np.uint8), minlength=256)
    share = counts / size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    top = Counter(words).most_common(1)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in text.split(b"\n") if line]
    present = share[share > 0]
    ends = np.bincount([word[-1] for word in words] or [32], minlength=256)
    starts = np.bincount([word[0] for word in words] or [32], minlength=256)
    odd = n - ends[48:58].sum() - ends[65:91].sum() - ends[97:123].sum() - ends[128:].sum() - ends[[44, 46]].sum()
    return [
        float(value)
        for value in (
            np.log1p(size),
            np.log1p(len(words)),
            share[65:91].sum(),
            share[97:123].sum(),
            share[48:58].sum(),
            share[9:14].sum() + share[32],
            share[10] ** 0.5,
            share[[44, 46]].sum(),
            share[33] ** 0.5,
            share[124] ** 0.5,
            share[_SYMBOLS].sum() ** 0.5,
            share[128:].sum(),
            -(present * np.log2(present)).sum(),
            lengths.mean() if words else 0.0,
            lengths.std() if words else 0.0,
            len(set(words)) / n,
            (top[0][1] if top else 0) / n,
            (pairs + 1) / n,
            (same / n) ** 0.5,
            max(odd, 0) / n,
            starts[65:91].sum() / n,
            len(set(lines)) / max(len(lines), 1),
            np.log1p(size / max(len(lines), 1)),
        )
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every text, one row per row."""
    kind = docs.schema[key].dataType.simpleString()
    return per_text(
        docs, key, text, f"doc_id {kind}, x array<double>", lambda k, t: {"doc_id": k, "x": list(map(statistics, t))}
    )


@dataclass(frozen=True)
class Model:
    """A fitted model: bounded, whatever the size of the training rows."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one column per fold left out, then the final one
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a constant."""
        return _expand((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.expand(x) @ self.weights[:, -1], self.knots, self.levels)


def _expand(z: np.ndarray) -> np.ndarray:
    random = np.random.default_rng(SEED)
    size = len(FEATURES)
    # Width of the kernel: the usual distance of two standardised rows, halved.
    directions = random.standard_normal((size, RANDOM_FEATURES)) / np.sqrt(size / 2)
    phases = random.uniform(0, 2 * np.pi, RANDOM_FEATURES)
    waves = np.cos(np.clip(z, -6, 6) @ directions + phases) * np.sqrt(2 / RANDOM_FEATURES)
    return np.hstack([waves, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on points sorted by x: (centres, levels) of the pools, levels rising."""
    pools: list[list[float]] = []
    for at, level, heavy in zip(x, y, weight):
        pools.append([at * heavy, level * heavy, heavy])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _fold(key):
    return F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int")


def fit(training: DataFrame) -> Model:
    """Fit on (doc_id, x, y), y from 0 to 1. Without any row the model gives 0.5 to every text."""
    size = len(FEATURES)
    columns = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)]
    columns += [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)]
    first = training.agg(F.count("*").alias("n"), *columns).first()
    width = RANDOM_FEATURES + 1
    if not first["n"]:
        nothing = np.zeros(size)
        return Model(nothing, nothing + 1, np.zeros((width, FOLDS + 1)), np.array([0.0]), np.array([0.5]))
    mean = np.array([first[f"m{i}"] for i in range(size)])
    scale = np.array([first[f"s{i}"] or 0.0 for i in range(size)])
    scale = np.where(scale > 1e-9, scale, 1.0)

    def add_up(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, size)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            wide = _expand((x - mean) / scale)
            for fold in np.unique(folds):
                rows = wide[folds == fold]
                part = np.hstack([rows.T @ rows, (rows.T @ y[folds == fold])[:, None]])
                sums[fold] = sums.get(fold, 0) + part
        for fold, part in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()), "part": [part.tobytes()]})

    def total(frame):
        parts = [np.frombuffer(part) for part in frame["part"]]
        return frame.iloc[:1].assign(part=[np.sum(parts, axis=0).tobytes()])

    rows = training.select("x", F.col("y").cast("double"), _fold("doc_id").alias("fold"))
    parts = rows.coalesce(32).mapInArrow(add_up, "fold int, part binary")
    summed = parts.groupBy("fold").applyInPandas(total, "fold int, part binary").collect()
    by_fold = {row["fold"]: np.frombuffer(bytes(row["part"])).reshape(width, width + 1) for row in summed}
    every = np.sum(list(by_fold.values()), axis=0)
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-6

    def solve(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[:, :width] + penalty, sums[:, width])

    weights = np.stack([solve(every - by_fold.get(fold, 0)) for fold in range(FOLDS)] + [solve(every)], axis=1)

    def unseen(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, size)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            raw = (_expand((x - mean) / scale) * weights[:, folds].T).sum(axis=1)
            bins = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    bins = (
        rows.mapInArrow(unseen, "bin int, y double")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("good"))
        .orderBy("bin")
        .collect()
    )
    at = np.array([(row["bin"] + 0.5) * 2 / BINS - 0.5 for row in bins])
    n, good = (np.array([float(row[name]) for row in bins]) for name in ("n", "good"))
    knots, levels = isotonic(at, good / n, n)
    return Model(mean, scale, weights, knots, np.clip(levels, 0, 1))


def held_out(key):
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    ``labels`` has doc_id and quality (0 or 1; null labels are left out, several of one document are averaged). Held-out
    documents' labels are not used. Null and empty texts are scored by their statistics, which are 0. Rows
    with a null key are scored and not learned from; repeated rows repeat; empty tables give an empty one, and without
    labels every score is 0.5. Columns other than those named are not read.
    """
    found = write_down(document_statistics(docs, key, text))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    training = write_down(found.where(~held_out("doc_id")).join(known, "doc_id").select("doc_id", "x", "y"))
    model = fit(training)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            scores = np.clip(model.score(x), 0, 1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good; columns are those of ``docs``.

    A document goes as a whole: if rows repeat a key, one rejected text rejects them all. Rows with a null key stay, as
    nothing tells them apart.
    """
    return reject(docs, score_documents(docs, labels, key, text).where("predicted = 0"), key)


def reject(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``rejected.doc_id``."""
    return rows_with(docs, key, rejected.select("doc_id").distinct(), "left_anti")
