import hashlib
import random

import pytest

from logquarry.llm.anchors import anchors
from logquarry.llm.repeats import remove_repeats


def brute(texts, length):
    """Every window of every text, by its bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(d[p : p + length], []).append((i, p))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for d, g in zip(data, gone):
        kept = bytes(x for x, y in zip(d, g) if not y)
        spans = sum(1 for k, y in enumerate(g) if y and (k == 0 or not g[k - 1]))
        out.append((len(d), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed, n, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(length // 3) for _ in range(3)]
    texts = [None, "", "short", "x" * (length - 1), "y" * length, "z" * (3 * length), "ab" * length]
    for _ in range(n):
        parts = [prose(r.randint(0, 60)) for _ in range(3)]
        p = r.choice(passages)
        a, b = sorted(r.sample(range(len(p)), 2))
        parts.insert(r.randint(0, 3), p if r.random() < 0.4 else p[a:b])
        if r.random() < 0.2:
            parts.append(p)
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2], texts[-2]]
    base = texts[-4]
    for _ in range(6):
        k = r.randrange(len(base))
        texts.append(base[:k] + "#" + base[k + 1 :])
    return texts


@pytest.mark.parametrize("length,fan,seed", [(60, 3, 1), (60, 3, 2), (90, 4, 3), (400, 7, 4)])
def test_against_brute_force(make, length, fan, seed):
    texts = sample(seed, 40, length)
    rows = remove_repeats(make([(i, t) for i, t in enumerate(texts)]), length, fan).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert all(len(r["kept_text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in rows)
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_edges(spark, make):
    assert remove_repeats(make([])).count() == 0
    pick = random.Random(5)
    long = "".join(pick.choice("abcdefgh") for _ in range(500))
    rows = remove_repeats(make([(None, long), (7, long), (7, long), (8, None), (None, "")])).collect()
    assert sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in rows) == [
        (False, 0, 0), (False, 500, 500), (False, 500, 500), (True, 0, 0), (True, 500, 500)]
    more = make([(1, long, "k", 1)], "doc_id long, text string, key string, pos long")
    assert [r["n_removed"] for r in remove_repeats(more).collect()] == [0]
    with pytest.raises(ValueError):
        remove_repeats(more, length=20)


def test_a_shared_folder_is_asked_for_on_clusters():
    from types import SimpleNamespace

    from logquarry.llm.tables import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=context)
    with pytest.raises(ValueError):
        shared_dir(session)
    context.getCheckpointDir = lambda: "hdfs://store/x/"
    assert shared_dir(session) == "hdfs://store/x"


def test_anchor_of_a_window_depends_on_its_bytes():
    r = random.Random(3)
    inner = bytes(r.randrange(256) for _ in range(100))
    found = []
    for pad in (0, 13, 57):
        data = bytes(r.randrange(256) for _ in range(pad)) + inner + bytes(r.randrange(256) for _ in range(50))
        place, _, first, last = anchors(data, 16, 85)
        found.append(next(p - pad for p, a, b in zip(place, first, last) if a <= pad <= b))
    assert len(set(found)) == 1
