"""Secrets in texts: written patterns, and a network that judges every other string that could be one.

Patterns find assignments of passwords and tokens, access keys and hexadecimal strings; what they find
stays.  Every other run of twelve signs or more that keys are made of is a candidate.  A convolutional
network over its characters and those around it (secret_net.py) gives a probability, and candidates that
reach the threshold of their class become findings too.

The network learns from findings that are labelled by how they were found: values that a pattern saw being
assigned, or that begin like an access key, are secrets; candidates that no pattern touches are not.
Hexadecimal strings alone are neither, as checksums look like keys.  Few texts hold secrets, and those of
one kind, so each is also shown with its value drawn anew in another alphabet, and with the surroundings
of another candidate: what a secret looks like must count, not only the word before it.  Likewise plain
candidates are shown in capitals or joined, and numbers and times in their place.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.secret_net import BEFORE, BEHIND, Candidate, Network, calibrate, fit
from logquarry.llm.tables import text_bytes, with_carried
from logquarry.llm.tokens import slices

#: Kinds of findings, in the order of those that begin at one place.
KINDS = ("assign", "access", "hex", "learned")
# The look-ahead only lets the search pass over signs that begin no key.
_ASSIGN = re.compile(rb"""(?i)(?=[pasST])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/][A-Za-z0-9+/_.-]{10,}[A-Za-z0-9+/_-]={0,2}")
#: Least length of an assigned value.
VALUE = 12

#: Bounds of training: documents whose findings are looked at (about so many), distinct findings of each
#: class, and examples drawn for each class.
DOCS, ROWS, DRAWN = 20_000, 3_000, 3_000
#: Share of labelled secrets, unseen in training, that thresholds must find at least.
RECALL = 0.95

Place = tuple[int, int, int]


def written(data: bytes) -> list[Place]:
    """(number of the kind, start, end) of what patterns find, in bytes."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= VALUE]
    found += [(1, *m.span()) for m in _ACCESS.finditer(data)]
    return found + [(2, *m.span()) for m in _HEX.finditer(data)]


def others(data: bytes, known: Sequence[Place]) -> list[tuple[int, int]]:
    """Places of candidates that touch nothing known."""
    spans = [m.span() for m in _CANDIDATE.finditer(data)]
    if not known or not spans:
        return spans
    # Known places sorted by their ends: the first that ends behind a candidate's start must begin behind its end.
    taken = sorted((b, a) for _, a, b in known)
    ends = [b for b, _ in taken]
    least = np.minimum.accumulate([a for _, a in taken][::-1])[::-1]
    at = np.searchsorted(ends, [a for a, _ in spans], "right")
    return [s for s, i in zip(spans, at.tolist()) if i == len(ends) or least[i] >= s[1]]


def around(data: bytes, start: int, end: int) -> Candidate:
    return data[max(0, start - BEFORE) : start], data[start:end], data[end : end + BEHIND]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(1).to_pylist():
            if not data:
                continue
            known = written(data)
            rows += [(True, *around(data, *m.span(2))) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= VALUE]
            rows += [(True, *around(data, a, b)) for kind, a, b in known if kind == 1]
            rows += [(False, *around(data, a, b)) for a, b in others(data, known)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.bool_(), *[pa.binary()] * 3))], names=["secret", "before", "value", "behind"])


def labelled_findings(docs: DataFrame, most: int = DOCS) -> DataFrame:
    """secret, before, value, behind: labelled findings of about most documents, one for each value.

    Documents are picked by a hash of their texts, as many as a hash below a share of all gives, so copies
    are picked together and a value counts once.
    """
    n = docs.count()
    share = min(1.0, most / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))) if share < 1 else docs
    found = text_bytes(picked).mapInArrow(_labelled, "secret boolean, before binary, value binary, behind binary")
    return found.groupBy("secret", "value").agg(F.min(F.struct("before", "behind")).alias("c")).select("secret", "c.before", "value", "c.behind")


_ALPHABETS = (
    b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def drawn(secrets: Sequence[Candidate], plain: Sequence[Candidate], n: int, seed: int) -> list[Candidate]:
    """n examples of secrets: most with a value in another alphabet, in their own or another's surroundings."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        before, value, behind = secrets[i % len(secrets)]
        if r.random() < 0.7:
            alphabet, size = r.choice(_ALPHABETS), r.choice((len(value), r.randint(16, 64)))
            value = b""
            while not any(48 <= x < 58 for x in value):  # words in capitals are of such letters, too
                value = bytes(r.choices(alphabet, k=size))
        if r.random() < 0.5 and plain:
            before, _, behind = r.choice(plain)
        out.append((before, value, behind))
    return out


def ordinary(plain: Sequence[Candidate], n: int, seed: int) -> list[Candidate]:
    """n examples of what is no secret: words in capitals, words joined by signs, numbers and times, in the
    surroundings of plain candidates."""
    r = random.Random(seed)
    digits = lambda k: bytes(r.choices(b"0123456789", k=k))
    out = []
    for i in range(n):
        before, value, behind = plain[i % len(plain)]
        way = r.randrange(4)
        if way == 0:
            value = value.upper()
        elif way == 1:
            value = r.choice((b"-", b"_", b"/", b".")).join((value, r.choice(plain)[1]))
        elif way == 2:
            value = r.choice((b"", b"-", b".", b"/")).join(digits(r.randint(3, 5)) for _ in range(r.randint(4, 6)))
        else:
            value = b"20" + b"-".join(digits(2) for _ in range(3)) + r.choice((b"T", b"-", b"_", b"/")) + r.choice((b"", b"-", b".")).join(digits(2) for _ in range(3))
        out.append((before, value, behind))
    return out


def train(findings: DataFrame, rows: int = ROWS, examples: int = DRAWN, recall: float = RECALL) -> Network | None:
    """A network from labelled findings (secret, before, value, behind); None if no five secrets are labelled.

    Of each class the rows findings with the least hash of their value are used; those whose hash is
    divisible by four are kept from training and set the scale and the thresholds, which find recall of them
    at least.
    """
    mixed = F.xxhash64("value")
    side = lambda flag: findings.where(F.col("secret") == flag).orderBy(mixed, "value").limit(rows).select("before", "value", "behind", (F.pmod(mixed, F.lit(4)) == 0).alias("held")).collect()
    both = {flag: side(flag) for flag in (True, False)}
    if len(both[True]) < 5:
        return None
    pick = lambda flag, held: [(bytes(x[0]), bytes(x[1]), bytes(x[2])) for x in both[flag] if x["held"] == held]
    sets = {}
    for held, n in ((False, examples), (True, examples // 4)):
        secrets, plain = pick(True, held), pick(False, held)
        secrets += drawn(secrets, plain, n, int(held)) if secrets else []
        plain += ordinary(plain, n, int(held)) if plain else []
        sets[held] = secrets + plain, [True] * len(secrets) + [False] * len(plain)
    net = fit(*sets[False])
    if any(sets[True][1]):
        calibrate(net, *sets[True], recall)
    return net


_FINDINGS = "array<struct<kind: string, start: long, end: long, score: double>>"
SCHEMA = f"doc_id long, findings {_FINDINGS}"


def _scanned(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        for part in slices(batch):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            base = [written(t) for t in texts]
            rest = [others(t, b) if net else [] for t, b in zip(texts, base)]
            row = [i for i, spans in enumerate(rest) for _ in spans]
            spans = [s for one in rest for s in one]
            p, secret = net.is_secret([around(texts[i], *s) for i, s in zip(row, spans)]) if spans else (np.empty(0), np.empty(0, bool))
            found: list[list] = [[(a, k, b, None) for k, a, b in known] for known in base]
            for j in np.flatnonzero(secret).tolist():
                found[row[j]].append((spans[j][0], 3, spans[j][1], float(p[j])))
            lists = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in _in_code_points(t, sorted(f, key=lambda x: x[:3]))] if f else [] for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, kind), *part.columns[2:]], names=["doc_id", "findings", *part.schema.names[2:]])


def _in_code_points(data: bytes, found: list) -> list:
    if data.isascii():
        return found
    further = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 == 0x80)))
    return [(a - int(further[a]), k, b - int(further[b]), s) for a, k, b, s in found]


def scan_secrets(docs: DataFrame, net: Network | None, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and findings (kind, start, end, score), by start, then
    by the order of KINDS.

    Places are in code points, the end exclusive.  assign, access and hex are the patterns' findings, each
    kind by itself from left to right; they may overlap and have no score.  learned are candidates that
    touch none of these and that net calls secrets, with their probabilities; without a net there are none.
    A null text is empty; every byte that continues no code point counts as one, in texts that are no UTF-8
    too.  Repeated rows and null ids are scanned each by itself.  The columns named by carry come in a
    struct, carried; others are ignored.  Narrow: no shuffle.
    """
    return text_bytes(docs, carry).mapInArrow(lambda b: _scanned(b, net), with_carried(SCHEMA, docs, carry))


def places(findings: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
