"""A convolutional network over characters that scores whether a string is a secret, in NumPy.

A candidate is a string with the bytes before and behind it.  Bytes become learned vectors, to which one
of three vectors is added for the part that they stand in; filters of five bytes slide over all of it; the
greatest answer of each filter before, in and behind the candidate and its mean in the candidate, together
with the length, go through one hidden layer to a number.  Strings of any length are taken whole: long
ones slide by in pieces whose answers are put together.

Scores are made probabilities on findings that training has not seen, and a candidate counts as a secret
from the threshold of its class on.  No threshold may miss more than a set share of these findings; of those that
do not, it is the one half way between the greatest and the number of the plain candidate next below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Bytes of context before and behind a candidate, and how wide filters are.
BEFORE, BEHIND, WIDTH = 24, 8, 5
_EDGE = WIDTH // 2
#: Sizes of byte vectors, filters and the hidden layer.
VECTOR, FILTERS, HIDDEN = 10, 24, 16
#: Positions that are worked on at once.
_BLOCK = 1 << 15
_PAD = np.uint8(0)
_ID = np.full(256, 98, np.uint8)  # beyond ASCII
_ID[:128] = 97  # controls
_ID[32:127] = np.arange(1, 96)
_ID[10] = 96
KINDS = 99

Candidate = tuple[bytes, bytes, bytes]


@dataclass
class Windows:
    """Candidates one behind the other: ids of bytes, their parts, and four marks of each candidate: where the
    bytes before it, itself, the bytes behind it and the gap to the next begin."""

    ids: np.ndarray
    parts: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray


def windows(candidates: Sequence[Candidate]) -> Windows:
    gap = b"\0" * _EDGE
    raw, ahead, after, sizes = [], [], [], []
    for before, value, behind in candidates:
        before, behind = before[-BEFORE:], behind[:BEHIND]
        raw += [gap, before.rjust(BEFORE, b"\0"), value, behind.ljust(BEHIND, b"\0"), gap]
        ahead.append(len(before))
        after.append(len(behind))
        sizes.append(len(value))
    data = np.frombuffer(b"".join([*raw, b"\0"]), np.uint8)  # the last gap, too, begins within the answers
    n = np.array(sizes, np.int64)
    whole = n + BEFORE + BEHIND + 2 * _EDGE
    start = np.cumsum(whole) - whole
    whole[-1] += 1
    marks = start[:, None] + np.column_stack((np.full_like(n, _EDGE), np.full_like(n, _EDGE + BEFORE), _EDGE + BEFORE + n, _EDGE + BEFORE + n + BEHIND))
    text = np.zeros(len(data), np.int8)  # 1 where bytes are a text's, 0 in what fills up
    text[marks[:, 1] - ahead] += 1
    text[marks[:, 2] + after] -= 1
    ids = np.where(np.cumsum(text, dtype=np.int8) == 1, _ID[data], _PAD)
    lengths = np.column_stack((marks[:, 1] - start, n, start + whole - marks[:, 2]))
    parts = np.repeat(np.tile(np.arange(3, dtype=np.uint8), len(n)), lengths.ravel())
    return Windows(ids, parts, marks, n)


@dataclass
class Network:
    """Weights by name; fit() makes them."""

    w: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    #: The least probability of a secret among candidates behind a sign of assignment, and among others.
    limits: dict[str, float] = field(default_factory=lambda: {"keyed": 0.5, "bare": 0.5})

    def _answers(self, x: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, answers) of all filters at each position but the outer ones."""
        vectors = self.w["byte"][x.ids] + self.w["part"][x.parts]
        wide = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=0).transpose(0, 2, 1).reshape(-1, WIDTH * VECTOR)
        return wide, np.maximum(wide @ self.w["filter"] + self.w["filter0"], 0)

    def _pooled(self, x: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled answers of each candidate, inputs, answers)."""
        wide, answers = self._answers(x)
        cuts = (x.marks - _EDGE).ravel()
        top = np.maximum.reduceat(answers, cuts).reshape(len(x.sizes), 4, FILTERS)
        mean = np.add.reduceat(answers, cuts).reshape(len(x.sizes), 4, FILTERS)[:, 1] / x.sizes[:, None]
        return np.concatenate((top[:, 0], top[:, 1], top[:, 2], mean, np.log2(x.sizes)[:, None] / 8), 1).astype(answers.dtype), wide, answers

    def _long(self, x: Windows) -> np.ndarray:
        """Pooled answers of one long candidate, block by block."""
        cuts, f = (x.marks[0] - _EDGE).tolist(), FILTERS
        top, total = np.zeros((3, f), np.float32), np.zeros(f)
        for at in range(0, cuts[3], _BLOCK):
            block = slice(at, at + _BLOCK + 2 * _EDGE)
            _, answers = self._answers(Windows(x.ids[block], x.parts[block], x.marks, x.sizes))
            for k in range(3):
                mine = answers[max(0, cuts[k] - at) : max(0, min(_BLOCK, cuts[k + 1] - at))]
                if len(mine):
                    top[k] = np.maximum(top[k], mine.max(0))
                    total += mine.sum(0) * (k == 1)
        return np.concatenate((top.ravel(), total / x.sizes[0], np.log2(x.sizes) / 8)).astype(np.float32)

    def logits(self, candidates: Sequence[Candidate]) -> np.ndarray:
        """A number for each candidate, before it is made a probability."""
        out = np.empty(len(candidates))
        for at, group in _blocks(candidates):
            long = len(group) == 1 and len(group[0][1]) > _BLOCK
            pooled = self._long(windows(group))[None] if long else self._pooled(windows(group))[0]
            hidden = np.maximum(pooled @ self.w["hidden"] + self.w["hidden0"], 0)
            out[at : at + len(group)] = (hidden @ self.w["out"] + self.w["out0"])[:, 0]
        return out

    def probabilities(self, candidates: Sequence[Candidate]) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.logits(candidates) + b)

    def is_secret(self, candidates: Sequence[Candidate]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, whether it reaches the threshold of its class) of each candidate."""
        p = self.probabilities(candidates)
        return p, p >= np.array([self.limits[class_of(c)] for c in candidates])

    def _gradients(self, x: Windows, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, wide, answers = self._pooled(x)
        raw = pooled @ self.w["hidden"] + self.w["hidden0"]
        hidden = np.maximum(raw, 0)
        p = _sigmoid((hidden @ self.w["out"] + self.w["out0"])[:, 0])
        d = ((p - wanted) * weight / weight.sum())[:, None].astype(pooled.dtype)
        g = {"out": hidden.T @ d, "out0": d.sum(0)}
        d = (d @ self.w["out"].T) * (raw > 0)
        g |= {"hidden": pooled.T @ d, "hidden0": d.sum(0)}
        d = d @ self.w["hidden"].T
        f = FILTERS
        cuts = x.marks - _EDGE
        back = np.zeros_like(answers)
        for k in range(3):  # what was greatest takes the gradient; zeros take none
            n = cuts[:, k + 1] - cuts[:, k]
            rows = np.repeat(cuts[:, k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            here = answers[rows]
            back[rows] += (here == np.repeat(pooled[:, k * f : (k + 1) * f], n, 0)) * np.repeat(d[:, k * f : (k + 1) * f], n, 0)
            if k == 1:
                back[rows] += np.repeat(d[:, 3 * f : 4 * f] / x.sizes[:, None].astype(np.float32), n, 0)
        back *= answers > 0
        g |= {"filter": wide.T @ back, "filter0": back.sum(0)}
        into = (back @ self.w["filter"].T).reshape(-1, WIDTH, VECTOR)
        vectors = np.zeros((len(x.ids), VECTOR), np.float32)
        for k in range(WIDTH):
            vectors[k : k + len(into)] += into[:, k]
        g["byte"] = np.eye(KINDS, dtype=np.float32)[x.ids].T @ vectors
        g["part"] = np.eye(3, dtype=np.float32)[x.parts].T @ vectors
        return g


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _blocks(candidates: Sequence[Candidate]) -> Iterator[tuple[int, Sequence[Candidate]]]:
    """Runs of candidates with _BLOCK positions or little more; a longer one is a run of its own."""
    at, held = 0, 0
    for i, c in enumerate(candidates):
        n = len(c[1]) + BEFORE + BEHIND + 2 * _EDGE
        if i > at and (held + n > _BLOCK or len(c[1]) > _BLOCK):
            yield at, candidates[at:i]
            at, held = i, 0
        held += n
    if at < len(candidates):
        yield at, candidates[at:]


def class_of(candidate: Candidate) -> str:
    """keyed: behind a sign of assignment, quotes and blanks aside; bare otherwise."""
    return "keyed" if candidate[0].rstrip(b" \t\"'`")[-1:] in (b"=", b":") else "bare"


def _start(r: np.random.Generator) -> dict[str, np.ndarray]:
    shape = {
        "byte": (KINDS, VECTOR), "part": (3, VECTOR), "filter": (WIDTH * VECTOR, FILTERS), "filter0": (FILTERS,),
        "hidden": (4 * FILTERS + 1, HIDDEN), "hidden0": (HIDDEN,), "out": (HIDDEN, 1), "out0": (1,),
    }
    return {k: (r.normal(0, 0.5 if k in ("byte", "part") else (2 / s[0]) ** 0.5, s) * (not k.endswith("0"))).astype(np.float32) for k, s in shape.items()}


def fit(candidates: Sequence[Candidate], wanted: Sequence[bool], rounds: int = 12, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Network:
    """A network trained on candidates that are (wanted) or are not secrets; both classes weigh the same."""
    r = np.random.default_rng(seed)
    y = np.array(wanted, np.float32)
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum())).astype(np.float32)
    net = Network(_start(r))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        mixed = r.permutation(len(y))
        for rows in (mixed[i : i + batch] for i in range(0, len(mixed), batch)):
            step += 1
            g = net._gradients(windows([candidates[i] for i in rows]), y[rows], weight[rows])
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                net.w[k] = net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def calibrate(net: Network, candidates: Sequence[Candidate], wanted: Sequence[bool], recall: float) -> None:
    """Set what makes net's numbers probabilities, and the thresholds, on candidates that fit() has not seen."""
    y = np.array(wanted, float)
    z = net.logits(candidates)
    a, b = 1.0, 0.0
    # Targets a little inside 0 and 1, so that numbers far apart do not make the slope endless.
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(50):  # Newton's method
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    net.scale = (float(max(a, 1e-3)), float(b))
    z = net.scale[0] * z + net.scale[1]
    classes = np.array([class_of(c) for c in candidates])
    for name in net.limits:
        found = np.sort(z[(y == 1) & (classes == name)])
        if len(found):  # so many of the least may be missed; below that, nearer to secrets than to what else there is
            limit = found[min(int((1 - recall) * len(found)), len(found) - 1)]
            below = z[(y == 0) & (z < limit)]
            net.limits[name] = float(_sigmoid((limit + below.max()) / 2 if len(below) else limit))
