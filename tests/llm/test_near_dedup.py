import random
import re

import numpy as np
import pyarrow as pa

from logquarry.llm import near_dedup
from logquarry.llm.near_dedup import _compared, near_duplicates


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiéß") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append("\t".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    # A chain whose ends do not link, and a wide family of drifting copies.
    base = [r.choice(vocabulary) for _ in range(100)]
    for k in range(8):
        base[(13 * k) % 100] = f"x{k}"
        texts.append(" ".join(base))
    texts += ["", None, "one two", "ONE two", "one", " \n "]
    r.shuffle(texts)
    return list(enumerate(texts, 5))


def test_against_brute_force(make):
    for seed, width in ((1, 4), (2, 5)):
        rows = corpus(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows).repartition(5), width).collect()}
        assert got == brute(rows, width, 80)


def test_wide_family_in_blocks(make, monkeypatch):
    """Drifting copies whose members mostly miss each other, in blocks of any size."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in r.sample(range(120), r.randint(0, 6)):
            copy[k] = f"x{r.randrange(10**6)}"
        rows.append((i * 3, " ".join(copy)))
    want = brute(rows, 4, 80)
    assert len({c for _, c, _ in want.values()}) > 2
    for block in (7, 384):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows), 4).collect()}
        assert got == want


def test_edges(make):
    assert near_duplicates(make([])).count() == 0
    rows = near_duplicates(make([(None, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (3, 3, True), (9, 3, False), (9, 3, False)]
    # One id with two texts ties both groups together.
    rows = near_duplicates(make([(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (4, "p q r s t")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (4, 1)}
    more = make([(1, "a b", 0.5, "x")], "doc_id long, text string, band double, hash string")
    assert near_duplicates(more).collect()[0]["kept"]


def test_block_pairs_are_compared_as_batches_come():
    taken = []

    def batches():
        for g in range(6):
            taken.append(g)
            items = np.arange(9, dtype=np.uint64).tobytes()
            yield pa.RecordBatch.from_pylist([{"band": g, "hash": -1, "x": 0, "y": 0, "block": 0, "rep": i, "component": i, "buckets": [{"band": g, "hash": -1}], "items": items} for i in (2 * g, 2 * g + 1)])

    made = _compared(batches(), 80)
    assert next(made).to_pydict() == {"a": [0], "b": [1]} and taken == [0, 1]
    assert [a for batch in made for a in batch.column(0).to_pylist()] == [2, 4, 6, 8, 10]


def test_few_rows_are_compared_like_blocks():
    r = random.Random(2)
    for x, y in ((0, 0), (0, 1)):
        base = np.array(sorted(r.sample(range(10**6), 200)), np.uint64)
        rows = []
        for i in range(12):
            items = np.unique(np.concatenate((base[r.randint(0, 60) :], np.array(r.sample(range(10**6), 10), np.uint64))))
            rows.append({"band": 3, "hash": 5, "x": x, "y": y, "block": i % 2 if y else 0, "rep": i, "component": i % 9, "buckets": [{"band": 3, "hash": 5}], "items": items.tobytes()})
        data = pa.Table.from_pylist(rows)

        def classes(links):
            of = {i: i % 9 for i in range(12)}
            for a, b in zip(*(c.tolist() for c in links)):
                p, q = sorted((of[a], of[b]))
                of = {i: p if c == q else c for i, c in of.items()}
            return of

        assert classes(near_dedup._few_links(data, 80)) == classes(near_dedup._block_links(data, 80)) != classes((np.empty(0, int),) * 2)
        for row in rows:  # an earlier bucket has met them all
            row["buckets"].append({"band": 1, "hash": 7})
        assert not len(near_dedup._few_links(pa.Table.from_pylist(rows), 80)[0])
