import random
import zlib

import numpy as np
import pytest

from logquarry.llm.packing import pack, plan, slots
from logquarry.llm.token_files import read_token_files, token_digests, token_file_round_trip, write_token_files
from logquarry.llm.tokens import Encoder, vocabulary

ODD = [
    "", "  a b  ", "\n\n x", "a\tb c", "Don't stop, it's 3.14%... ok.,x", "ÀÉ ÉCOLE, Straße. İstanbul", "<|endoftext|> a<|endoftext|>b", "日本 語, x", "a \n b",
    "a\n b", "x. ", "x.\ny,z", "école á", "\x1ca b", "a b c", "Å K", " .", "..,", "a ,b", "ǅ ß.", "The the THE. the, the.", "x" * 5000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_whole_text(name):
    e, r = Encoder(vocabulary(name)), random.Random(1)
    texts = ODD + ["".join(r.choice("abc ABé.,'\n\t3#️_%*(<") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want


def digests(texts, name, end):
    t = Encoder(vocabulary(name)).tokenizer
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts]


def test_token_files(spark, make, tmp_path):
    texts = ODD + [None]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in token_file_round_trip(make(rows).repartition(5), vocabulary("byte_bpe_50k.json")).collect()}
    at = 0
    for (doc_id, _), ids in zip(rows, digests(texts, "byte_bpe_50k.json", 2)):
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)
    assert token_file_round_trip(make([]), vocabulary("byte_bpe_50k.json")).count() == 0
    twice = token_file_round_trip(make([(2, "a b"), (2, "a b"), (None, "c")]), vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(r["start"] for r in twice) == [0, 2, 5]
    path = str(tmp_path / "ids")
    write_token_files(make(rows), path, vocabulary("byte_bpe_50k.json"))
    one = read_token_files(spark, path).where("doc_id = 4")
    assert "EqualTo(doc_id,4)" in one._jdf.queryExecution().toString() and token_digests(one).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([7, 20, 64])
    histogram = {n: r.choice([0, 1, 2, 15, 40]) for n in range(1, cap + 1)}
    patterns = plan({k: v for k, v in histogram.items() if v}, cap)
    used = {}
    for parts, times in patterns:
        assert sum(parts) <= cap and times > 0
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == {k: v for k, v in histogram.items() if v}
    room: list[int] = []  # plain best-fit decreasing, piece by piece
    for n in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [(x, i) for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(cap - n)
    assert sum(t for _, t in patterns) <= len(room) + 1
    assert set(slots(patterns, cap)) == set(used)


def test_pack(make):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "inn", "tion", "x,"]) for _ in range(r.choice([0, 1, 5, 20, 90]))) for _ in range(120)] + [None, ""]
    rows = list(enumerate(texts))
    got = pack(make(rows).repartition(4), vocabulary("word_bpe_49k.json"), capacity=32).collect()
    ids = dict(enumerate(digests(texts, "word_bpe_49k.json", 0)))
    places, seen = {}, {}
    for g in got:
        part = ids[g["doc_id"]][g["start"] : g["start"] + g["length"]]
        assert g["start"] == 32 * g["piece"] and len(part) == g["length"] and g["ids_crc32"] == zlib.crc32(part.tobytes())
        places.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
        seen[g["doc_id"]] = seen.get(g["doc_id"], 0) + g["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 32
    assert len(places) <= 1.05 * sum(map(len, ids.values())) / 32 + 2
    assert pack(make([]), vocabulary("word_bpe_49k.json")).count() == 0


def test_long_texts_repeated_rows_and_clashing_columns(make):
    r = random.Random(5)
    long = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(120_000))
    schema = "doc_id long, text string, shard string, place string, ids string, piece string, length string, rank int"
    extra = ("s", "p", "i", "q", "l", 7)
    rows = [(9, long, *extra), (4, "a b", *extra), (4, "a b", *extra), (None, None, *extra)]
    for name, end in (("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 0)):
        want = digests([long, "a b", ""], name, end)
        if end:
            got = sorted((x["start"], x["n_tokens"], x["ids_crc32"]) for x in token_file_round_trip(make(rows, schema), vocabulary(name)).collect())
            sizes = [want[2], want[1], want[1], want[0]]  # the null id comes first
            starts = [sum(map(len, sizes[:k])) for k in range(4)]
            assert got == [(a, len(x), zlib.crc32(x.tobytes())) for a, x in zip(starts, sizes)]
        else:
            got = pack(make(rows, schema), vocabulary(name)).collect()
            assert sum(x["length"] for x in got) == sum(map(len, want)) + len(want[1])
            whole = sorted((x["start"], x["length"], x["ids_crc32"]) for x in got if x["doc_id"] == 9)
            parts = [want[0][k : k + 2048] for k in range(0, len(want[0]), 2048)]
            assert whole == [(2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(parts)]


def test_texts_that_are_no_utf8(spark):
    import pyarrow as pa

    from logquarry.llm.tokens import as_texts, slices

    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array([b"a\xff b", None, b"x" * 50, b"y" * 50])], names=["doc_id", "text"])
    assert as_texts(batch.column(1)).to_pylist()[:2] == ["a\ufffd b", ""]
    assert [part.column(0).to_pylist() for part in slices(batch, 40)] == [[1, 2, 3], [4]]
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    assert len(e.lists(pa.array([], pa.string()))) == 0


def test_text_without_blanks_is_not_remembered():
    r = random.Random(5)
    encoder = Encoder(vocabulary("byte_bpe_50k.json"), cache=50)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(30)] + ["".join(r.choice("abcXYZ019+/") for _ in range(40)) for _ in range(400)]
    for text in texts:
        assert encoder.encode([text])[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    known = encoder.bare
    assert max(map(len, known)) <= 64 and known.size <= 3 * 32 * 50 and len(known.older) < 100
