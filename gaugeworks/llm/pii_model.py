"""A character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from gaugeworks.llm.pii_rules import KINDS

TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
EMBEDDING, HIDDEN = 16, 24
WINDOW, STRIDE = 48, 24
_PRINTABLE = {chr(code): code - 31 for code in range(32, 127)}
CHARACTERS = 99  # 0 is padding; then printable ones, white space, letters and others
_BLOCKED = -1e4
#: An at sign, or the word that stands for it.
SPELLED = re.compile(r"@|\bat\b", re.I)
#: A span that comes so near to the edge of what was run may go on beyond it.
EDGE = 8


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """The number of each code point."""
    points = map(chr, range(0x110000))
    return np.array([_PRINTABLE.get(c) or (96 if c.isspace() else 97 if c.isalpha() else 98) for c in points], np.int8)


def ids_of(text: str) -> np.ndarray:
    """A number per character: printable ASCII by itself, the rest by sort."""
    return _numbers()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _allowed() -> np.ndarray:
    """Which tag may follow which: the inside of a kind only its begin or inside."""
    fine = np.ones((TAGS, TAGS), dtype=bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        fine[:, inside] = False
        fine[[inside - 1, inside], inside] = True
    return fine


ALLOWED = _allowed()


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)

    def matrix(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    parameters = {"embedding": matrix(CHARACTERS, EMBEDDING), "out": matrix(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32)}
    for way in ("f", "b"):
        parameters |= {way + "x": matrix(EMBEDDING, 4 * HIDDEN), way + "h": matrix(HIDDEN, 4 * HIDDEN)}
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        parameters[way + "_b"] = bias
    return parameters | {"moves": np.zeros((TAGS, TAGS), np.float32)}


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
    """One direction over (batch, length, EMBEDDING)."""
    batch, length, _ = x.shape
    drive = x @ wx + b
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((batch, length, HIDDEN), np.float32)
    for t in range(length):
        z = drive[:, t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        out[:, t] = h
    return out


def _run_back(x, wx, wh, keep, d_out):
    """Gradients of one direction: (d_x, d_wx, d_wh, d_b)."""
    batch, length, _ = x.shape
    d_drive = np.empty((batch, length, 4 * HIDDEN), np.float32)
    d_wh, dh, dc = np.zeros_like(wh), np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1):
        h, before, i, f, o, g, squashed = keep[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)])
        d_drive[:, t] = dz
        d_wh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = d_drive.reshape(-1, 4 * HIDDEN)
    return d_drive @ wx.T, x.reshape(-1, EMBEDDING).T @ flat, d_wh, flat.sum(axis=0)


def emissions(parameters: dict, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(batch, length, TAGS) scores of windows of character numbers."""
    x = parameters["embedding"][ids]
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    ahead = _run(x, parameters["fx"], parameters["fh"], parameters["f_b"], kept["f"])
    back = _run(x[:, ::-1], parameters["bx"], parameters["bh"], parameters["b_b"], kept["b"])[:, ::-1]
    both = np.concatenate([ahead, back], axis=2)
    if keep is not None:
        keep |= {"x": x, "both": both, **kept}
    return both @ parameters["out"] + parameters["out_b"]


def _moves(parameters: dict) -> np.ndarray:
    return np.where(ALLOWED, parameters["moves"], _BLOCKED)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sums(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums over all tag sequences."""
    length = scores.shape[1]
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
    for t in range(length - 2, -1, -1):
        back[:, t] = _log_sum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    return ahead, back


def marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    ahead, back = _sums(scores, moves)
    return np.exp(ahead + back - _log_sum(ahead[:, -1], 1)[:, None, None])


def gradients(parameters: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(negative log-likelihood per window, its gradients)."""
    keep: dict = {}
    scores = emissions(parameters, ids, keep).astype(np.float64)
    moves = _moves(parameters)
    ahead, back = _sums(scores, moves)
    total = _log_sum(ahead[:, -1], 1)
    batch, length = ids.shape
    rows = np.arange(batch)[:, None]
    gold = scores[rows, np.arange(length), tags].sum() + moves[tags[:, :-1], tags[:, 1:]].sum()
    d_scores = np.exp(ahead + back - total[:, None, None])
    d_scores[rows, np.arange(length), tags] -= 1
    joint = ahead[:, :-1, :, None] + moves + (scores + back)[:, 1:, None, :] - total[:, None, None, None]
    d_moves = np.exp(joint).sum(axis=(0, 1))
    np.add.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    d_scores = (d_scores / batch).astype(np.float32)
    flat = d_scores.reshape(-1, TAGS)
    made = {"moves": np.where(ALLOWED, d_moves / batch, 0), "out_b": flat.sum(axis=0)}
    made["out"] = keep["both"].reshape(-1, 2 * HIDDEN).T @ flat
    d_both = d_scores @ parameters["out"].T
    x = keep["x"]
    d_x, made["fx"], made["fh"], made["f_b"] = _run_back(x, parameters["fx"], parameters["fh"], keep["f"], d_both[:, :, :HIDDEN])
    d_back, made["bx"], made["bh"], made["b_b"] = _run_back(
        np.ascontiguousarray(x[:, ::-1]), parameters["bx"], parameters["bh"], keep["b"], d_both[:, ::-1, HIDDEN:]
    )
    made["embedding"] = np.zeros_like(parameters["embedding"])
    np.add.at(made["embedding"], ids, d_x + d_back[:, ::-1])
    return float((total.sum() - gold) / batch), made


def train(ids: np.ndarray, tags: np.ndarray, rounds: int, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam over shuffled windows."""
    parameters, random = new_parameters(seed), np.random.default_rng(seed)
    first = {name: np.zeros_like(value) for name, value in parameters.items()}
    second = {name: np.zeros_like(value) for name, value in parameters.items()}
    step = 0
    for turn in range(rounds):
        order = random.permutation(len(ids))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            _, made = gradients(parameters, ids[rows], tags[rows])
            size = np.sqrt(sum(float((value**2).sum()) for value in made.values()))
            step += 1
            speed = rate * (0.5 ** (2 * turn / rounds)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, value in made.items():
                value = value * min(1, 5 / (size + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value**2
                parameters[name] = (parameters[name] - speed * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return parameters


def best_paths(stretches: list[np.ndarray], moves: np.ndarray, cells: int = 1 << 16) -> list[np.ndarray]:
    """Viterbi over several (length, TAGS) at once; a text begins outside or at a begin. At most ``cells`` places, or one stretch, at a time."""
    order = sorted(range(len(stretches)), key=lambda n: len(stretches[n]))
    paths: list[np.ndarray] = [np.zeros(0, np.int8)] * len(stretches)
    while order:
        # Of like length, the longest first, so that padding is little.
        some = order[-max(1, cells // len(stretches[order[-1]])) :]
        del order[-len(some) :]
        sizes = np.array([len(stretches[n]) for n in some])
        scores = np.zeros((len(some), sizes[-1], TAGS))
        for row, n in enumerate(some):
            scores[row, : sizes[row]] = stretches[n]
        total = scores[:, 0].copy()
        total[:, 2::2] += _BLOCKED
        back = np.zeros((sizes[-1], len(some), TAGS), np.int8)
        for t in range(1, sizes[-1]):
            first = int(np.searchsorted(sizes, t, "right"))  # rows are in order of length; those before have ended
            steps = total[first:, :, None] + moves
            back[t, first:] = steps.argmax(axis=1)
            total[first:] = steps.max(axis=1) + scores[first:, t]
        path, tag, rows = np.zeros((sizes[-1], len(some)), np.int8), total.argmax(axis=1), np.arange(len(some))
        for t in range(sizes[-1] - 1, -1, -1):
            path[t] = tag
            live = sizes > t
            tag = np.where(live, back[t, rows, tag], tag)
        for row, n in enumerate(some):
            paths[n] = path[: sizes[row], row]
    return paths


def best_tags(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Viterbi over (length, TAGS)."""
    return best_paths([scores], moves)[0].tolist()


def decode(parameters: dict, texts: list[str], at_a_time: int = 512) -> list[list[tuple[int, int, str, float]]]:
    """Spans (start, end, kind, certainty) of each text.

    Windows lie on a fixed grid and overlap by half. A span of any kind holds a digit, an at sign or the word in its place,
    so the windows around those are run, and the next ones wherever a span reaches the edge of what was run. The scores of a
    character from its windows are averaged, more the nearer it is to the middle; one Viterbi path runs over each stretch
    of windows, so no span is cut where windows meet.
    """
    numbers = [ids_of(text) if text else np.zeros(0, np.int64) for text in texts]
    blocks: list[set[int]] = []
    for text, ids in zip(texts, numbers):
        near = {int(mark) // STRIDE for mark in np.nonzero((ids >= 17) & (ids <= 26))[0]}
        near |= {match.start() // STRIDE for match in SPELLED.finditer(text or "")}
        blocks.append(near | {block - 1 for block in near if block > 0})
    spans: list[list] = [[] for _ in texts]
    asked = [n for n, near in enumerate(blocks) if near]
    while asked:
        found = _decode(parameters, [numbers[n] for n in asked], [blocks[n] for n in asked], at_a_time)
        again = []
        for n, (made, wider) in zip(asked, found):
            spans[n] = made
            if not wider <= blocks[n]:
                blocks[n] = blocks[n] | wider
                again.append(n)
        asked = again
    return spans


def _decode(parameters: dict, numbers: list[np.ndarray], blocks: list[set[int]], at_a_time: int) -> list[tuple[list, set[int]]]:
    """The spans of each text over its blocks, and the blocks that those at an edge ask for."""
    places = [(n, block * STRIDE) for n, near in enumerate(blocks) for block in sorted(near)]
    windows = []
    for n, start in places:
        window = np.zeros(WINDOW, np.int64)
        part = numbers[n][start : start + WINDOW]
        window[: len(part)] = part
        windows.append(window)
    scores = [emissions(parameters, np.array(windows[a : a + at_a_time])) for a in range(0, len(windows), at_a_time)]
    scores = np.concatenate(scores).astype(np.float64) if scores else np.zeros((0, WINDOW, TAGS))
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)[:, None]
    moves, spans = _moves(parameters), [([], set()) for _ in numbers]
    first, stretches = 0, []
    while first < len(places):
        last = first
        while last + 1 < len(places) and places[last + 1][0] == places[first][0] and places[last + 1][1] - places[last][1] <= STRIDE:
            last += 1
        n, base = places[first]
        size = min(places[last][1] + WINDOW, len(numbers[n])) - base
        total, heavy = np.zeros((size + WINDOW, TAGS)), np.zeros((size + WINDOW, 1))
        for which in range(first, last + 1):
            at = places[which][1] - base
            total[at : at + WINDOW] += weight * scores[which]
            heavy[at : at + WINDOW] += weight
        stretches.append((n, base, places[last][1] // STRIDE, total[:size] / heavy[:size]))
        first = last + 1
    paths = best_paths([mean for _, _, _, mean in stretches], moves)
    for (n, base, block, mean), path in zip(stretches, paths):
        if not path.any():
            continue  # no span, so nobody asks how certain it is
        made = _spans(path.tolist(), marginals(mean[None], moves)[0], base)
        spans[n][0].extend(made)
        if base > 0 and any(start < base + EDGE for start, _, _, _ in made):
            spans[n][1].add(base // STRIDE - 1)
        if base + len(mean) < len(numbers[n]) and any(end > base + len(mean) - EDGE for _, end, _, _ in made):
            spans[n][1].add(block + 1)
    return spans


def _spans(tags: list[int], sure: np.ndarray, base: int) -> list[tuple[int, int, str, float]]:
    found, at = [], 0
    while at < len(tags):
        tag = tags[at]
        if tag % 2 == 0:
            at += 1
            continue
        end = at + 1
        while end < len(tags) and tags[end] == tag + 1:
            end += 1
        certainty = float(min(sure[at, tag], sure[at + 1 : end, tag + 1].min(initial=1.0)))
        found.append((base + at, base + end, KINDS[tag // 2], certainty))
        at = end
    return found
