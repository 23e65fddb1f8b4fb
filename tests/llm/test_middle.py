"""Fill-in-the-middle against a plain pattern, and back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logquarry.llm.middle import Cutter, Mix, fill_in_middle, restored

PATTERN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t \r", "one", "  two words ", "x\x0by\x0cz", "non\xa0breaking  wide \x1c\x85 end", "日本 語テキスト🙂 é \x00 nul",
    "holds <P> a mark", "<S>", "<M", "a <P", "P> b <", "S> < M>", "<" * 50, "a\n\nb\n" * 30,
]


def brute(doc_id, text, mix=Mix()):
    text = text or ""
    h = hashlib.sha256(f"{mix.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = PATTERN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= mix.changed:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < mix.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_text(r):
    return "".join(r.choice("ab  \n\t日é🙂<>PSM\x1c\x00") for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("mix", [Mix(), Mix(100, 30, 7)])
def test_against_brute_force(make, mix):
    r = random.Random(1)
    texts = TEXTS + [odd_text(r) for _ in range(300)] + [" ".join(odd_text(r) for _ in range(4000))]
    made = fill_in_middle(make(list(enumerate(texts))), mix, ["text"])
    rows = made.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    forms = set()
    for x in rows:
        got = tuple(x[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output"))
        assert got == brute(x["doc_id"], texts[x["doc_id"]], mix)
        assert x["back"] == (texts[x["doc_id"]] or "") and x["carried"]["text"] == texts[x["doc_id"]]
        forms.add(x["form"])
    assert len(rows) == len(texts) and forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("part", [1, 2, 3, 7, 64])
def test_seams_of_long_texts(part):
    r = random.Random(part)
    cutter = Cutter(part)
    for text in [t for t in TEXTS if t] + [odd_text(r) for _ in range(200)] + ["x" * 1000, " " * 1000, "é " * 500]:
        assert cutter.starts(text) == [m.start() for m in PATTERN.finditer(text)]


def test_edge_rows(spark, make):
    assert fill_in_middle(make([])).count() == 0
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (5, "x y", 3), (5, "x y", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("form", F.lit("own")).withColumn("output", F.lit(0))
    got = fill_in_middle(odd, Mix(100), ["n", "form"]).collect()
    assert sorted((x["n"], x["carried"]["n"], x["carried"]["form"]) for x in got) == [(2, 3, "own"), (2, 3, "own"), (4, 1, "own"), (4, 2, "own")]
    assert len({x["output"] for x in got}) == 2
    broken = spark.sql("select 3L as doc_id, cast(x'61FF6220C3' as string) as text")
    got = fill_in_middle(broken, Mix(100)).first()
    assert got["n"] == 2 and got["output"].count("�") == 2
