"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

Over a stretch of text, a forward Viterbi pass gives each position the best score of a path to it.
Walking back from the end, that score is the exact cost of the rest, so A* search pops complete paths
in order of their scores and expands nothing in vain.  Stretches end where no piece reaches across;
they are independent, so the N best of a text are the N least sums of their losses, and only the N - 1
words with the smallest first loss can differ from the best path.  That loss needs no search: it is the
difference between the two best scores that a forward pass can carry along.

Piece scores are log-probabilities of a Zipf distribution over the vocabulary's order.  They are whole
micro-nats, so sums are exact.  Characters without a piece fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logquarry.llm.tables import text_bytes

BLANK = "▁"
#: Words that a worker remembers the best paths of; one counts by its bytes as so many usual ones.  Longer
#: words than LONG are cut where no piece reaches across, as text without blanks is one word a line.
CACHE = 700_000
LONG, USUAL = 64, 64
_NEVER = 1 << 60
#: No piece reaches across the end of such a part: a word with the blanks before it, blanks, a line end.
_WORD = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_lattices: dict[tuple, "Lattice"] = {}

Paths = list[tuple[int, bytes]]


class _Words(dict):
    """(score, ids, loss of the second best path or _NEVER) of words, computed when first asked for."""

    def __init__(self, owner: "Lattice"):
        super().__init__()
        self.owner, self.size = owner, 0

    def __missing__(self, word: str) -> tuple[int, bytes, int]:
        # A mark that no piece joins to what is before it only adds to that: not worth keeping.
        if len(word) > 2 and word[-1] in ".,:;!?" and word[-2:] not in self.owner.joined:
            (s, ids, loss), (t, more, other) = self[word[:-1]], self[word[-1]]
            return s + t, ids + more, min(loss, other)
        found = self.owner.word(word)
        if len(word) <= LONG:
            self[word] = found
            self.size += max(USUAL, 4 * len(word) + len(found[1]))
        return found


class Lattice:
    """Best segmentations under the vocabulary file at path."""

    def __init__(self, path: str, n: int):
        from sentencepiece import SentencePieceProcessor

        self._set(SentencePieceProcessor(model_file=path), n)

    def _set(self, model, n: int) -> None:
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        ranks = {i: min(-model.get_score(i), float(size)) for i in usable}
        norm = math.log(sum(1 / (r + 2) for r in ranks.values()))
        self.n = n
        self.ids = {model.id_to_piece(i): i for i in usable}
        self.scores = {i: -round(1e6 * (math.log(r + 2) + norm)) for i, r in ranks.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(self.scores.values()) - 10_000_000
        self.raw = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        #: Pieces by their characters, node by node; a node's "" is the (score, id) of the piece it ends.
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (self.scores[i], i)
        #: Neighbours inside some piece; between any others every path divides.
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self._forget()

    def _forget(self) -> None:
        self.words = _Words(self)
        self.deep: dict[str, Paths] = {}

    def edges(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, score, id) of all pieces in a stretch by start; id -1 stands for bytes."""
        out, n = [], len(text)
        for i in range(n):
            if text[i] not in self.ids:
                out.append((i, i + 1, self.byte_score * len(text[i].encode("utf-8", "replace")), -1))
            node = self.root
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    out.append((i, j + 1, *node[""]))
        return out

    def _ids(self, text: str, start: int, piece: int) -> tuple[int, ...]:
        if piece >= 0:
            return (piece,)
        return tuple(self.byte_ids[b] for b in text[start].encode("utf-8", "replace"))

    def _cuts(self, word: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _forward(edges: list[tuple[int, int, int, int]], n: int) -> tuple[list, list]:
        """Best score of a path to each position, and the edge that it ends with."""
        best = [0] + [-_NEVER] * n
        last: list = [None] * (n + 1)
        for edge in edges:
            i, j, s, _ = edge
            s += best[i]
            if s > best[j]:
                best[j] = s
                last[j] = edge
        return best, last

    def word(self, word: str) -> tuple[int, bytes, int]:
        """(score, ids, loss of the second best path or _NEVER) of a word's best path.

        A forward pass keeps the two best scores to each position.
        """
        n, root, ids = len(word), self.root, self.ids
        best, second = [0] + [-_NEVER] * n, [-_NEVER] * (n + 1)
        last: list = [None] * (n + 1)
        for i in range(n):
            one, two = best[i], second[i]
            if word[i] not in ids:
                s = self.byte_score * len(word[i].encode("utf-8", "replace"))
                if one + s > best[i + 1]:
                    second[i + 1], best[i + 1], last[i + 1] = best[i + 1], one + s, (i, -1)
                elif one + s > second[i + 1]:
                    second[i + 1] = one + s
                if two + s > second[i + 1]:
                    second[i + 1] = two + s
            node = root
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                end = node.get("")
                if end is not None:
                    j += 1
                    s = one + end[0]
                    if s > best[j]:
                        second[j], best[j], last[j] = best[j], s, (i, end[1])
                    elif s > second[j]:
                        second[j] = s
                    if two + end[0] > second[j]:
                        second[j] = two + end[0]
        path, at = [], n
        while at:
            at, piece = last[at]
            path.append((at, piece))
        out: list[int] = []
        for i, piece in reversed(path):
            out.extend(self._ids(word, i, piece))
        return best[n], np.array(out, "<u4").tobytes(), best[n] - second[n] if second[n] > -_NEVER // 2 else _NEVER

    def search(self, text: str) -> Paths:
        """The n best (score, ids) of a stretch, best first."""
        edges = self.edges(text)
        best, _ = self._forward(edges, len(text))
        ending: list[list] = [[] for _ in range(len(text) + 1)]
        for edge in edges:
            ending[edge[1]].append(edge)
        out: Paths = []
        # A state: minus (score so far + best score to its position), a number for ties, position, path.
        heap: list = [(-best[-1], 0, len(text), 0, None)]
        count = 0
        while heap and len(out) < self.n:
            _, _, at, gone, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((gone, np.array(ids, "<u4").tobytes()))
                continue
            for i, _, s, piece in ending[at]:
                count += 1
                heapq.heappush(heap, (-(gone + s + best[i]), count, i, gone + s, (self._ids(text, i, piece), path)))
        return out

    def best_of_word(self, word: str) -> Paths:
        """The n best of a word, from those of its stretches."""
        parts = [self.search(text) for text in self._cuts(word)]
        out = parts[0]
        for other in parts[1:]:
            both = [(a + b, x + y) for a, x in out for b, y in other]
            both.sort(key=lambda p: -p[0])
            out = both[: self.n]
        return out

    def encode(self, text: str) -> Paths:
        """The n best (score, ids as little-endian 32-bit integers) of a whole text, best first; one empty
        path for an empty text.

        A blank is put before the text and blanks become BLANK, as the vocabulary was made for.
        """
        if not text:
            return [(0, b"")]
        if self.words.size > USUAL * CACHE:
            self._forget()
        words = _WORD.findall(BLANK + text.replace(" ", BLANK))
        if max(map(len, words)) > LONG:
            words = [part for w in words for part in (self._cuts(w) if len(w) > LONG else (w,))]
        known = self.words
        scores, chosen, losses = zip(*[known[w] for w in words])
        score, chosen = sum(scores), list(chosen)
        order = np.argsort(np.array(losses, np.int64), kind="stable")[: self.n - 1].tolist()
        few = sorted(i for i in order if losses[i] < _NEVER)
        paths = []
        for i in few:
            w = words[i]
            mine = self.deep.get(w)
            if mine is None:
                mine = self.best_of_word(w)
                if len(w) <= LONG:
                    if len(self.deep) > CACHE // 10:
                        self.deep = {}
                    self.deep[w] = mine
            paths.append(mine)
        choices: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        for mine in paths:
            choices = heapq.nsmallest(self.n, ((loss + mine[0][0] - s, picks + (k,)) for loss, picks in choices for k, (s, _) in enumerate(mine)))
        out = []
        for loss, picks in choices:
            for i, k, mine in zip(few, picks, paths):
                chosen[i] = mine[k][1]
            out.append((score - loss, b"".join(chosen)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of a path."""
        raw = self.raw
        text = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text else text


def lattice(path: str, n: int) -> Lattice:
    """This worker's lattice for a vocabulary file."""
    if (path, n) not in _lattices:
        _lattices[path, n] = Lattice(path, n)
    return _lattices[path, n]


def _segmented(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part, mine = batch.slice(k, 200), lattice(path, n)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = (text or b"").decode("utf-8", "replace")
                paths = mine.encode(text)
                whole = mine.decode(paths[0][1]) == text.replace(BLANK, " ")
                digests = [zlib.crc32(ids) for _, ids in paths]
                rows.append((doc_id, len(paths[0][1]) // 4, digests[0], [s for s, _ in paths], digests, whole))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            names = ["doc_id", "n_pieces", "ids_crc32", "scores", "path_crc32", "restored"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def segment(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_pieces and ids_crc32 of the best path,
    scores (micro-nats) and path_crc32 of the n best, best first, and restored: whether decoding the best
    path gives the text back (a BLANK of its own counts as a blank).

    A null or empty text has one empty path.  Null ids and repeated rows are passed on, further columns
    ignored.  Paths of equal score come in an order fixed by the search.  Narrow: no shuffle.
    """
    return text_bytes(docs).mapInArrow(
        lambda b: _segmented(b, model_path, n),
        "doc_id long, n_pieces long, ids_crc32 long, scores array<long>, path_crc32 array<long>, restored boolean",
    )
