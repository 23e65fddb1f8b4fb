"""The audit of filters against loops over documents and orders."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np

from logquarry.llm.filter_audit import Scanner, audit_filters, text_facts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    text = text or ""
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text)


def brute(docs, labels):
    """(part, order, step) to its counts, by applying each order to each document."""
    fails, judged = [], defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            judged[i][0] |= quality == 1
            judged[i][1] |= toxic == 1
    for i, text, source in docs:
        words, distinct, capitals, symbols, points = facts(text)
        mine = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0}
        mine["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        fails.append((source or "", {x for x in "ABCDE" if mine[x]}, *(judged[i] if i is not None else [False, False])))
    out = {}
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                before = [x for x in mine if x not in left]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                redundant = sum(letter in f and bool(f & set(order[:k])) for _, f, _, _ in mine)
                assert k or not before
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(f == {letter} for _, f, _, _ in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def random_docs(r, n):
    pool = ["", "short text", "x " * 300, "Word WORD # " * 120]
    for _ in range(12):
        words = ["".join(r.choice("abcdeXY é日#") for _ in range(r.randint(1, 20))) for _ in range(r.randint(1, 150))]
        pool.append(" ".join(r.choice(words) for _ in range(r.randint(0, 420))))
    return [(r.choice([i, i, i, None, i // 2]), r.choice([*pool, None]), r.choice(["a", "a", "b", None, ""])) for i in range(n)]


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_brute_force(spark, make):
    r = random.Random(3)
    docs = random_docs(r, 150)
    labels = [(r.randint(0, 160), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(120)] + [(None, 1, 1)]
    frame = make([(i, t, s, 0) for i, t, s in docs], "doc_id long, text string, source string, mask int")
    got = audit_filters(frame, make(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(docs, labels)
    assert {(x["part"], x["filter_order"], x["step"]): [x[c] for c in COLUMNS] for x in got} == want
    assert len(got) == len(want) == 600 * len({x[0] for x in want})
    for part in ("a", "b", ""):  # what all filters remove together, each order says
        mine = [x for x in got if x["part"] == part]
        gone = {o: sum(x["removed"] for x in mine if x["filter_order"] == o) for o in {x["filter_order"] for x in mine}}
        assert len(set(gone.values())) == 1
        by_filter = {x["filter_order"][x["step"] - 1]: x["shapley"] for x in mine}
        assert sum(by_filter.values()) == math.factorial(5) * next(iter(gone.values()))


def test_facts(make):
    r = random.Random(8)
    texts = [None, "", " ", "a", "a a A", "\x1c \x85 \xa0", "x" * 100_000 + " " + "x" * 100_000 + " " + "x" * 99_999 + "y", "日本 日本 語"] + [t for _, t, _ in random_docs(r, 80)]
    texts += ["".join(r.choice("ab\n\t \x0b\x0c\ré") for _ in range(r.randint(0, 200))) for _ in range(300)]
    rows = text_facts(make(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x["n_words"], x["n_distinct"], x["n_capitals"], x["n_symbols"], x["n_points"]) == facts(texts[x["doc_id"]])


def test_windows_and_equal_hashes():
    r = random.Random(5)
    texts = ["".join(r.choice("abc  \n") for _ in range(r.randint(0, 300))).encode() for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    want = [facts(t.decode())[:2] for t in texts]
    for window in (1, 8, 100, 1 << 20):
        words, distinct, *_ = Scanner(window).counts(data, offsets)
        assert list(zip(words.tolist(), distinct.tolist())) == want

    class Same(Scanner):  # all words share a hash, so bytes decide
        def word_hashes(self, data, start, end):
            return np.zeros(len(start), np.uint64)

    words, distinct, *_ = Same().counts(data, offsets)
    assert list(zip(words.tolist(), distinct.tolist())) == want


def test_no_documents(make):
    empty = make([], "doc_id long, text string, source string")
    assert audit_filters(empty, make([], "doc_id long, quality int, toxic int")).count() == 0
