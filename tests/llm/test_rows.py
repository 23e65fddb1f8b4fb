"""Operators that judge rows by themselves: quality, toxicity, licenses."""

import math
import random
import re
import string
from collections import Counter

import pytest
import xxhash
import zstandard

from logquarry.llm import quality as quality_rules
from logquarry.llm.license_scan import BASE, Signature, scan_licenses, signatures
from logquarry.llm.quality import quality
from logquarry.llm.toxicity import OrdinalModel, fit, severity, train_on_labels

TEXTS = [
    None, "", " \n\t", "one", "a b c " * 40, "Ünïcode wörds 日本 | # $ %", "x y\n\nx y\n x y\nz", "w\x0bv\x1cu\x85t s", "<p> &amp; * *", "Is Is Is Is", "a b a b a b",
    "\n".join(["same line here"] * 30 + ["other"]),
]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_quality(make):
    r = random.Random(2)
    noise = " ".join("".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(700))
    long_repeat = prose(r, 60) + " " + "zzzzz" * 4000
    texts = TEXTS + [prose(r, n) for n in (49, 50, 300, 3000)] + [long_repeat, noise]
    rows = {x["doc_id"]: x for x in quality(make(list(enumerate(texts))), ["text"]).collect()}
    for i, t in enumerate(texts):
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["base_failed"]) == counts(t)
        assert got["carried"]["text"] == t and not (got["base_failed"] and got["kept"])
    n = len(texts)
    assert [rows[i]["kept"] for i in range(n - 6, n - 2)] == [False, True, True, True]
    assert rows[n - 2]["verdict"] == "repetitive"
    assert quality(make([])).count() == 0
    twice = quality(make([(1, "a"), (1, "a"), (None, "a")])).collect()
    assert len(twice) == 3


def verdict_of(text):
    """The verdict of a text, with ratios from the compressor itself."""
    data = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    n_words, *_, failed = counts(text)
    if failed:
        return "few words" if n_words < 50 else "repeated phrases"
    n = max(1, (len(data) + quality_rules.CHUNK // 2) // quality_rules.CHUNK) if len(data) >= quality_rules.CHUNK // 2 else 0
    pieces = [data[i * quality_rules.CHUNK : (i + 1) * quality_rules.CHUNK if i < n - 1 else None] for i in range(n)]
    judged = [(ratio(data), *max((b for b in quality_rules.WHOLE_BANDS if b[0] <= len(data)))[1:])]
    judged += [(ratio(p), *max((b for b in quality_rules.CHUNK_BANDS if b[0] <= len(p)))[1:]) for p in pieces]
    if any(x > most for x, _, most in judged):
        return "repetitive"
    return "incompressible" if any(x < least for x, least, _ in judged) else "kept"


def test_verdicts_against_brute_force(make):
    r = random.Random(12)
    noise = lambda n: " ".join("".join(r.choice(PRINTABLE) for _ in range(6)) for _ in range(n // 7))
    texts = [*TEXTS, prose(r, 60) + " " + "zzzzz" * 4000]
    for size in (300, 1000, 2040, 2048, 2060, 4096, 5000, 6143, 6144, 8192, 10239, 10240, 40000):
        texts += [prose(r, size // 6)[:size], noise(size)[:size], prose(r, size // 6)[: size // 2] + " " + noise(size // 2), (prose(r, 70) + "\n") * (size // 300 + 1)]
        texts.append(prose(r, size // 6)[:size] + noise(1900))  # noise in a rest shorter than half a chunk
    got = {x["doc_id"]: x["verdict"] for x in quality(make(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [verdict_of(t) for t in texts]
    assert {"kept", "incompressible", "repetitive"} <= set(got.values())


BASE64, PRINTABLE = string.ascii_letters + string.digits + "+/", "".join(map(chr, range(33, 127)))


def test_incompressible(make):
    """Noise of several lengths and noise inside prose go, prose of these lengths stays."""
    r = random.Random(3)
    lengths = (400, 700, 1200, 2500, 5000, 20000, 100000)

    def noise(signs, size):
        return " ".join("".join(r.choice(signs) for _ in range(r.randint(3, 9))) for _ in range(size // 4))[:size]

    noises = [noise(signs, n) for signs in (BASE64, PRINTABLE) for n in lengths]
    inside = [prose(r, 2000) + " " + noise(signs, 8192) + " " + prose(r, 2000) for signs in (BASE64, PRINTABLE)]
    clean = [prose(r, n)[:n] for n in lengths]
    rows = {x["doc_id"]: x["verdict"] for x in quality(make(list(enumerate(noises + inside + clean)))).collect()}
    assert [rows[i] for i in range(len(rows))] == ["incompressible"] * len(noises + inside) + ["kept"] * len(clean)


BAD = ["vile", "nasty", "filth"]


def labelled(seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(r, r.randint(20, 120)).split()
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "ly", "ish"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(make):
    docs, labels = labelled(1, 1500)
    model = train_on_labels(make(docs), make(labels[:900], "doc_id long, toxic int"), sample=400)
    assert list(model.thresholds) == sorted(model.thresholds)
    truth = dict(labels)
    rows = severity(make(docs), model).collect()
    held = [x for x in rows if x["doc_id"] >= 900]
    hits = sum(x["toxic"] for x in held if truth[x["doc_id"]])
    assert hits >= 0.97 * sum(truth[x["doc_id"]] for x in held)
    assert sum(x["toxic"] for x in held if not truth[x["doc_id"]]) <= 0.02 * len(held)
    for x in rows[:50]:
        assert x["p_above"] == sorted(x["p_above"], reverse=True) and abs(sum(x["p_above"]) - x["expected_severity"]) < 1e-5
    again = train_on_labels(make(docs[::-1]), make(labels[:900][::-1], "doc_id long, toxic int"), sample=400)
    assert again.weights.keys() == model.weights.keys()


def test_toxicity_against_brute_force(make):
    """The fitted model's grades of all texts, feature by feature; very long, null and repeated ones too."""
    docs, labels = labelled(3, 400)
    docs += [(400, " ".join(t for _, t in docs[:200]) * 20), (401, None), (402, "?!"), (5, docs[5][1])]
    model = train_on_labels(make(docs), make(labels, "doc_id long, toxic int"))
    got = sorted((x["doc_id"], x["n_known_features"], x["grade"], x["toxic"], x["kept"], round(x["expected_severity"], 4)) for x in severity(make(docs), model).collect())
    want = []
    for doc_id, text in docs:
        times = {}
        for word in re.findall(r"\w+", (text or "").lower()):
            for f in [word] + [word[:n] + "-" for n in (4, 5, 6) if len(word) > n]:
                times[f] = times.get(f, 0) + 1
        known = [f for f in times if f in model.weights]
        score = sum(model.weights[f] * (1 + math.log(times[f])) for f in known)
        expected = sum(1 / (1 + math.exp(min(50, max(-50, t - score)))) for t in model.thresholds)
        grade = int(expected + 0.5)
        want.append((doc_id, len(known), grade, grade > 0, grade == 0, round(expected, 4)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert all(abs(g[5] - w[5]) < 2e-4 for g, w in zip(got, sorted(want)))
    extra = make([(1, "vile vile", "x", 1, 2)], "doc_id long, text string, grade string, word int, kept int")
    assert severity(extra, model).columns[-1] == "kept"


def test_toxicity_edges(make):
    model = OrdinalModel({"vile": 9.0}, (4.0, 5.0, 6.0))
    rows = severity(make([(1, None), (2, ""), (None, "VILE!"), (2, "fine")]), model).collect()
    assert sorted(((x["doc_id"] or 0), x["toxic"]) for x in rows) == [(0, True), (1, False), (2, False), (2, False)]
    assert severity(make([]), model).count() == 0
    none = train_on_labels(make([(1, "a")]), make([(1, 0)], "doc_id long, toxic int"))
    assert not severity(make([(1, "a")]), none).first()["toxic"]
    odd = train_on_labels(make([(1, None), (None, "x"), (2, "")]), make([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert not severity(make([(1, "a")]), odd).first()["toxic"]


def test_toxicity_trains_on_all_but_copies(make):
    """Texts that share their word of least hash, across both classes, and rows without a known feature."""
    words = [f"common{i}" for i in range(2000)]
    least = min(words, key=xxhash.xxh3_64_intdigest)
    r = random.Random(6)
    docs = [(i, f"{least} {prose(r, 30)}" + (" vile nasty filth" if i % 2 else "")) for i in range(200)]
    docs += [(200, docs[0][1].upper() + "!"), (201, docs[0][1]), (202, docs[1][1]), (203, "?!"), (204, None), (205, "zyx")]
    labels = [(i, i % 2) for i in range(202)] + [(i, 0) for i in range(202, 206)]
    model = train_on_labels(make(docs), make(labels, "doc_id long, toxic int"))
    # 200 is a copy of 0; 201 and 202 are copies of rows of the other class; 203 and 204 are both empty.
    assert model.rows_used == (100 + 1 + 1 + 1, 100 + 1)
    rows = severity(make([(1, "so vile, nasty filth"), (2, f"{least} of plain words")]), model).collect()
    assert [x["toxic"] for x in sorted(rows, key=lambda x: x["doc_id"])] == [True, False]


def test_fit_orders_grades():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(0, 3, (600, 6)).astype(float)
    y = np.clip((x[:, 0] + x[:, 1] >= 2).astype(int) + (x[:, 0] + x[:, 1] >= 3) + (x[:, 0] + x[:, 1] >= 4), 0, 3)
    w, theta = fit(x, y, np.ones(600))
    assert w[0] > 1 and w[1] > 1 and np.abs(w[2:]).max() < 0.3 and (np.diff(theta) > 0).all()


def scanned(text):
    """All rules on all of a text, keyword by keyword and priority by priority, without any gate."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    norm = f" {' '.join(words)} "
    base = []
    for phrase, label in BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    groups = {}
    for i, s in enumerate(signatures()):
        groups.setdefault((s.keyword, s.priority), []).append((i, s))
    found = []
    for rules in groups.values():
        for m in re.finditer(f"(?<= )(?:{'|'.join(s.pattern for _, s in rules)})(?= )", norm):
            assert rules[0][1].keyword in m[0]
            found.append((*m.span(), *next((s, i) for i, s in rules if re.fullmatch(s.pattern, m[0]))))
    kept = []
    for a, b, s, i in found:
        rank = lambda z: (-z[2].priority, z[2].label, z[2].confidence, z[3])
        over = [z for z in found if z[0] <= a and b <= z[1] and z[2].priority >= s.priority and ((z[0], z[1]) != (a, b) or rank(z) < rank((a, b, s, i)))]
        if not over:
            kept.append(s)
    labels = {x for _, x in base} | {s.label for s in kept}
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max((s.confidence for s in kept), default=0.0), len(kept))


LICENSES = [
    None, "", "no terms here", "MIT License", "Licensed under the Apache License, Version 2.0.", "the GNU General Public License v3 or the GNU Lesser General Public License version 2.1",
    "CC BY CC-BY cc by-nc 4.0, Licensed under CC BY-SA 3.0", "SPDX-License-Identifier: GPL-3.0-or-later\n// apache license apache license", "Creative Commons Attribution ShareAlike 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Neither the name of the Foo Inc. nor the names of its contributors may be used to endorse it",
    "All rights reserved. all rights reserved", "École MIT Licence mit licensee", "boost software license 1.0; distributed under the Boost Software License, Version 1.0", "cc0 1.0 cc0", "x " * 300 + "mit license " * 40,
    "Dual licensed under Apache 2.0 or MIT; apache license v2.0 with LLVM exception", "you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPLv2.1, GPLv3 and AGPL v3", "released under the BSD 3-Clause License (New BSD), 0BSD, BSD-style license", "placed in the public domain; no part of this book may be reproduced",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ http://www.gnu.org/licenses/gpl-3.0.html https://opensource.org/licenses/MIT", "\u212a mit licence MIT LICENSE \u0130 CC BY",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "This is free and unencumbered software released into the public domain. unlicense.org", "mit der Lizenz", "sublicense gplx",
]


def test_licenses(make):
    assert len(signatures()) >= 300
    rows = {x["doc_id"]: x for x in scan_licenses(make(list(enumerate(LICENSES)))).collect()}
    for i, text in enumerate(LICENSES):
        x = rows[i]
        got = (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["score"], x["n_found"])
        assert got == scanned(text), text


def test_every_rule_has_its_keyword_and_can_match(make):
    """A text written from each expression is detected by it or by one before it."""
    texts = []
    for s in signatures():
        text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", s.pattern))
        text = text.replace("[cs]", "c").replace("[sz]", "s").replace("[1234] [05]", "4 0").replace("[123]", "3").replace("[23]", "3").replace("[^ ]{1,4}", "xyz").replace("[^ ]+ {1,20}", "some ")
        text = re.sub(r"(.)\?", r"\1", text)
        assert re.fullmatch(s.pattern, text), s.pattern
        texts.append(text)
    rows = {r["doc_id"]: r for r in scan_licenses(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["n_found"] >= 1 and (rows[i]["labels"], rows[i]["n_found"]) == (scanned(text)[5], scanned(text)[7]), text


def test_license_overlaps(make):
    rules = [Signature("inner", "b", "b", 1, 0.5), Signature("outer", "a", "a b c", 1, 0.6), Signature("strong", "b", "b c", 3, 0.9)]
    x = scan_licenses(make([(1, "a b c"), (1, "a b c"), (None, "b")]), rules).collect()
    assert sorted((r["labels"], r["score"]) for r in x) == [("inner", 0.5), ("outer,strong", 0.9), ("outer,strong", 0.9)]
    assert scan_licenses(make([])).count() == 0


@pytest.mark.parametrize("schema", ["doc_id long, text string, norm string, found string, kept boolean"])
def test_clashing_columns(make, schema):
    rows = make([(1, "mit license " + "word " * 60, "n", "f", True)], schema)
    assert scan_licenses(rows).first()["labels"] == "mit"
    assert quality(rows).first()["n_words"] == 62 and severity(rows, OrdinalModel({}, (1.0, 2.0, 3.0))).count() == 1


@pytest.mark.parametrize("phrase,label,n", [("mit license", "mit", 200_000), ("cc by", "cc-by", 200_000), ("GPLv3+ and ", "gpl", 20_000)])
def test_many_matches_in_one_text(make, phrase, label, n):
    row = scan_licenses(make([(1, f"{phrase} " * n)])).first()
    assert label in row["labels"].split(",") or any(x.startswith(label) for x in row["labels"].split(","))
    assert row["n_found"] >= n // 2 and row["n_words"] == n * len(re.findall("[a-z0-9]+", phrase.lower()))


def test_places_across_runs(make, monkeypatch):
    """Places come from sums of runs: the same whatever their length."""
    from logquarry.llm import license_scan

    docs = make(list(enumerate([t for t in LICENSES if t] + ["x mit license y " * 9 + "gnu general public license v3 " * 7])))
    whole = sorted(map(str, scan_licenses(docs).collect()))
    for run in (1, 3):
        monkeypatch.setattr(license_scan, "_RUN", run)
        assert sorted(map(str, scan_licenses(docs).collect())) == whole
