import random

import numpy as np
import pytest

from logquarry.llm.piece_lattice import BLANK, Lattice, segment
from logquarry.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def lattice():
    return Lattice(vocabulary("piece_bpe_32k.model"), 4)


def everything(lattice, text):
    """(score, ids) of all paths through a text's lattice."""
    text = BLANK + text.replace(" ", BLANK)
    paths = [[(0, b"")]] + [[] for _ in text]
    for i, j, s, piece in lattice.edges(text):
        ids = np.array(lattice._ids(text, i, piece), "<u4").tobytes()
        paths[j] += [(t + s, more + ids) for t, more in paths[i]]
    return sorted(paths[-1], key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["a", "the inn", "tion on", "x, y.", "né à", "  in", "日本\nab", "re re re"])
def test_n_best_is_the_head_of_all_paths(lattice, text):
    want = everything(lattice, text)
    got = lattice.encode(text)
    assert [s for s, _ in got] == [s for s, _ in want[:4]]
    assert len(set(got)) == len(got) and set(got) <= set(want)
    assert all(lattice.decode(ids) == text for _, ids in got)


def test_against_the_library_with_equal_scores(lattice):
    """The same pieces and scores as a unigram model of the sentencepiece library."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        if i in lattice.scores:
            piece.score, piece.type = lattice.scores[i] / 1e6, 1
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    r = random.Random(4)
    for _ in range(50):
        text = " ".join("".join(r.choice("ethinorws") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 6)))
        ids = library.encode(text)
        score = sum(lattice.scores[i] for i in ids)
        found = lattice.encode(text)
        assert len(found) == 1 or found[0][0] - found[1][0] == min(x[2] for x in map(lattice.word, (BLANK + text.replace(" ", " " + BLANK)).split(" ")) if x[2] < 1 << 60)
        assert abs(score - lattice.encode(text)[0][0]) <= 50  # the library adds up single precision


def test_query_columns(make):
    rows = {r["doc_id"]: r for r in segment(make([(1, "of the thing"), (2, None), (3, ""), (None, "é 🙂\n")]), vocabulary("piece_bpe_32k.model")).collect()}
    assert rows[1]["restored"] and len(rows[1]["scores"]) == 4 and sorted(rows[1]["scores"], reverse=True) == rows[1]["scores"]
    assert rows[2]["n_pieces"] == rows[3]["n_pieces"] == 0 and rows[None]["restored"]
    assert segment(make([]), vocabulary("piece_bpe_32k.model")).count() == 0


def test_long_texts_repeated_rows_and_clashing_columns(make):
    r = random.Random(8)
    long = " ".join(r.choice(["the", "inn", "tion", "re", "é"]) for _ in range(60_000))
    schema = "doc_id long, text string, scores string, n_pieces string, path_crc32 int"
    rows = segment(make([(1, long, "s", "n", 1), (2, "re re", "s", "n", 1), (2, "re re", "s", "n", 1)], schema), vocabulary("piece_bpe_32k.model")).collect()
    assert sorted(x["doc_id"] for x in rows) == [1, 2, 2] and all(x["restored"] for x in rows)
    assert max(x["n_pieces"] for x in rows) >= 60_000
    two = [x.asDict() for x in rows if x["doc_id"] == 2]
    assert two[0] == two[1]


def test_text_without_blanks(lattice):
    """Lines of thousands of signs are one word each: cut where no piece reaches across, and not remembered."""
    r = random.Random(3)
    signs = [chr(c) for c in range(0x4E00, 0x5200)] + list("aeiourstn0123")
    lines = ["".join(r.choice(signs) for _ in range(3000)) for _ in range(40)]
    for text in lines[:3]:
        whole, parts = lattice._cuts(BLANK + text), lattice.encode(text)
        assert parts[0][0] == sum(lattice.word(w)[0] for w in whole) and lattice.decode(parts[0][1]) == text
        assert [s for s, _ in parts] == [s for s, _ in lattice.best_of_word(BLANK + text)]
    assert max(map(len, lattice.words)) <= 64 and max(map(len, lattice.deep), default=0) <= 64
    before = lattice.words.size
    for text in lines:
        lattice.encode(text)
    assert lattice.words.size - before < 64 * len(signs) ** 2 / 100  # stretches, not lines
    assert lattice.decode(lattice.encode("\n".join(lines))[0][1]) == "\n".join(lines)
