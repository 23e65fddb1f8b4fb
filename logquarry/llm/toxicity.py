"""Toxicity grades by cumulative-link ordinal regression on sparse word counts.

One weight vector serves all thresholds: P(grade > j) = sigmoid(w . x - theta_j), theta rising with j.
The prediction is the expected grade; a text's grade is that, rounded, and it is toxic from grade 1 on.
Labels say only toxic or not, so training grades come from the label and from evidence words, which are
those that labelled toxic rows use and clean rows do not: 0 clean, 1 labelled toxic without evidence (a
mild or doubtful case), 2 some evidence, 3 much of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tables import save, text_bytes, with_carried

#: Labelled rows per class that training reads at most, and words that the model may use at most.
SAMPLE, WORDS = 3000, 2000
GRADES = 4
#: What a row labelled toxic weighs if nothing in it bears the label out.
DOUBT = 0.2
_WORD = re.compile(r"\w+")


#: Lengths of word beginnings that are features beside the words: they catch inflected forms.
PREFIXES = (4, 5, 6)
#: Words that a worker remembers the known features of.
CACHE = 150_000


def words_of(text: bytes) -> Counter:
    """Counts of lower-case words of a whole text."""
    return Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def feature_counts(text: bytes) -> Counter:
    """Counts of all features of a whole text."""
    out: Counter = Counter()
    for word, n in words_of(text).items():
        for feature in features_of(word):
            out[feature] += n
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """weights of features, rising thresholds, and how many rows labelled clean and toxic it was fitted on."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    rows_used: tuple[int, int] = (0, 0)

    def above(self, counts: Counter) -> list[float]:
        """P(grade > j) for each threshold j."""
        score = sum(self.weights[w] * (1 + math.log(n)) for w, n in counts.items() if w in self.weights)
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 500, lasso: float = 2.5e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the cumulative-logit loss, summed over all thresholds, with
    an L1 penalty on the weights of scaled columns; accelerated proximal gradient."""
    top = GRADES - 1
    weight = weight / weight.sum()
    mean = weight @ x
    scale = np.sqrt(np.maximum(weight @ (x * x) - mean * mean, 1e-4))
    x = (x - mean) / scale
    over = (y[:, None] > np.arange(top)).astype(float)
    v = np.ones(x.shape[1]) / math.sqrt(x.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 4 / (1.1 * top * max(size, 1.0) + top)
    w, theta = np.zeros(x.shape[1]), np.full(top, 2.0)
    w_ahead, t_ahead, momentum = w, theta, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x @ w_ahead)[:, None] - t_ahead, -40, 40)))
        slope = weight[:, None] * (p - over)
        new = w_ahead - step * (x.T @ slope.sum(1))
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        t_new = t_ahead + step * slope.sum(0)
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / after
        w_ahead, t_ahead = new + pull * (new - w), t_new + pull * (t_new - theta)
        w, theta, momentum = new, t_new, after
    w = w / scale
    return w, np.maximum.accumulate(theta + w @ mean)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of sampled texts, a null one for a text without words.  The key is a digest of all the
    text's words in their order: only copies, but for case, blanks and signs, share it."""
    for batch in batches:
        ids, keys, words, counts = [], [], [], []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:2])):
            sequence = " ".join(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))
            key = xxhash.xxh3_64_intdigest(sequence) >> 1
            for word, n in (feature_counts(text or b"") or {None: 0}).items():
                ids.append(doc_id)
                keys.append(key)
                words.append(word)
                counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
            names=["doc_id", "key", "word", "n"],
        )


def train_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows of each class, the ones whose ids hash lowest.

    Features are words and their beginnings.  Their statistics over the sample are computed in Spark;
    the driver receives at most ``words`` of them and their counts in the sampled rows.  Rows with a null id or label are left out, one row stays of
    those that share an id, or the class and all words in their order.  Every other sampled row is fitted,
    also one without a chosen feature.  Without both classes the model calls nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return OrdinalModel({}, tuple(50.0 + j for j in range(GRADES - 1)))
    low = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = F.broadcast(save(low[0].unionByName(low[1])))  # two times sample rows at most
    found = save(text_bytes(docs).join(picked, "doc_id").select("doc_id", "text").mapInArrow(_words, "doc_id long, key long, word string, n long"))
    heads = save(found.join(picked, "doc_id").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct())
    found = save(found.where("word is not null").join(F.broadcast(heads), "doc_id").groupBy("doc_id", "toxic", "word").agg(F.max("n").alias("n")))
    rows = heads.orderBy("doc_id").toArrow()
    ids, toxic = (rows[c].to_numpy() for c in ("doc_id", "toxic"))
    totals = Counter(toxic.tolist())
    if len(totals) < 2:
        return OrdinalModel({}, tuple(50.0 + j for j in range(GRADES - 1)))
    seen = found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(F.lit(1) - F.col("toxic")).alias("good")).where("bad + good >= 5")
    p, q = (F.col("bad") + 0.5) / (totals[1] + 1.0), (F.col("good") + 0.5) / (totals[0] + 1.0)
    pull = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    chosen = seen.orderBy(F.desc(pull), "word").limit(words).collect()
    index = {r["word"]: i for i, r in enumerate(chosen)}
    rate = [((r["bad"] + 0.5) / (totals[1] + 1), (r["good"] + 0.5) / (totals[0] + 1)) for r in chosen]
    evidence = {r["word"] for r, (a, b) in zip(chosen, rate) if a > 20 * b and r["bad"] >= max(5, 0.01 * totals[1])}

    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(index.items()), "word string, i int"))
    cells = found.join(wanted, "word").select("doc_id", "i", "n").toArrow()
    row, column, n = np.searchsorted(ids, cells["doc_id"].to_numpy()), cells["i"].to_numpy(), cells["n"].to_numpy()
    x = np.zeros((len(ids), max(1, len(index))), np.float32)
    x[row, column] = 1 + np.log(n)
    kinds = np.array([-1 if word not in evidence else len(word) if word.endswith("-") else 0 for word in index] or [-1])
    hits = np.zeros(len(ids))
    for kind in set(kinds.tolist()) - {-1}:
        mine = kinds[column] == kind
        hits = np.maximum(hits, np.bincount(row[mine], n[mine], len(ids)))
    y = np.where(toxic == 0, 0, np.where(hits == 0, 1, np.where(hits < 4, 2, 3)))
    # Classes weigh as in all labels, however many rows of them were sampled.
    weight = np.where(toxic == 0, sizes[0] / totals[0], sizes[1] / totals[1]) * np.where(y == 1, DOUBT, 1.0)
    w, theta = fit(x, y, weight)
    return OrdinalModel({word: float(w[i]) for word, i in index.items() if abs(w[i]) > 1e-6}, tuple(float(t) for t in theta), rows_used=(totals[0], totals[1]))


def _graded(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        n, tops, expected = [], [], []
        for text in batch.column(1).to_pylist():
            counts: Counter = Counter()
            words = words_of(text or b"")
            if len(known) + len(words) > CACHE:
                known = {}
            for word, times in words.items():
                mine = known.get(word)
                if mine is None:
                    mine = known[word] = tuple(f for f in features_of(word) if f in model.weights)
                for feature in mine:
                    counts[feature] += times
            above = model.above(counts)
            n.append(len(counts))
            tops.append([round(p, 6) for p in above])
            expected.append(round(sum(above), 6))
        grade = [int(e + 0.5) for e in expected]
        toxic = [g > 0 for g in grade]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(tops, pa.list_(pa.float64())),
                pa.array(expected, pa.float64()),
                pa.array(grade, pa.int32()),
                pa.array(toxic, pa.bool_()),
                pa.array([not t for t in toxic], pa.bool_()),
                *batch.columns[2:],
            ],
            names=["doc_id", "n_known_features", "p_above", "expected_severity", "grade", "toxic", "kept", *batch.schema.names[2:]],
        )


SCHEMA = "doc_id long, n_known_features long, p_above array<double>, expected_severity double, grade int, toxic boolean, kept boolean"


def severity(docs: DataFrame, model: OrdinalModel, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_known_features, p_above (P(grade > j)),
    expected_severity, grade (that, rounded), toxic (grade 1 or more), kept; the columns named by carry
    come in a struct, carried.

    A null or empty text scores as one without known features.  Null ids and repeated rows are passed
    on, further columns ignored.  Narrow: no shuffle; the model has a bounded number of features.
    """
    return text_bytes(docs, carry).mapInArrow(lambda b: _graded(b, model), with_carried(SCHEMA, docs, carry))
