"""Fill-in-the-middle: texts cut at two places between tokens, and put in another order.

A token is a run of signs with the blanks before it, so the tokens of a text are its matches of one
pattern, one behind the other.  The tokenizers library's Split step finds them with each match isolated,
and tells where each begins, in code points; nothing is trained.  The number of these offsets is n, and
the cuts are the offsets at two ranks.

Where the cuts lie and which form a document takes depends on the seed and its doc_id alone, so a lost
task gives the same rows again, and so does every run.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tables import text_bytes, with_carried
from logquarry.llm.tokens import as_texts, slices

BLANKS = " \t\n\x0b\x0c\r"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Code points that the library is given at once: it takes some fifty bytes for each.
PART = 1 << 18

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Mix:
    """Of 100 documents, changed are given another form (if they can be), spm of 100 of these the suffix first."""

    changed: int = 50
    spm: int = 80
    seed: int = 42


class Cutter:
    """Places of a text's tokens."""

    def __init__(self, part: int = PART):
        from tokenizers import Regex, pre_tokenizers

        self.part = part
        self.split = pre_tokenizers.Split(Regex(TOKEN), "isolated")

    def starts(self, text: str) -> list[int]:
        """Where each token begins.  Long texts are looked at in parts: a token begins at a seam only if a
        blank follows a sign there, otherwise the seam lies within a token that the part before began."""
        found: list[int] = []
        for at in range(0, len(text), self.part):
            own = [at + place[0] for _, place in self.split.pre_tokenize_str(text[at : at + self.part])]
            seam = at and (text[at] not in BLANKS or text[at - 1] in BLANKS)
            found += own[1:] if seam else own
        return found


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the SHA-256 of seed:doc_id, where no id is an empty one."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def rearranged(doc_id: int | None, text: str, mix: Mix, cutter: Cutter) -> tuple:
    """The columns of SCHEMA after doc_id for one text."""
    h1, h2, h3, h4 = draws(mix.seed, doc_id)
    starts = cutter.starts(text)
    n = len(starts)
    if not text or h3 % 100 >= mix.changed or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    starts.append(len(text))
    a, b = (starts[rank] for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < mix.spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _rearranged(batches: Iterator[pa.RecordBatch], mix: Mix) -> Iterator[pa.RecordBatch]:
    cutter = Cutter()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        for part in slices(batch):
            ids, texts = part.column(0).to_pylist(), as_texts(part.column(1)).to_pylist()
            columns = list(zip(*(rearranged(i, t, mix, cutter) for i, t in zip(ids, texts)))) or [()] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], names=names + part.schema.names[2:])


def fill_in_middle(docs: DataFrame, mix: Mix = Mix(), carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    form is plain where the text is empty, holds one of the marks, or is not drawn: output is the text then,
    and the lengths are null.  Otherwise output is <P>prefix<S>suffix<M>middle (psm) or
    <S>suffix<P>prefix<M>middle (spm).  A null text is empty; bytes that are no UTF-8 are replaced.  Rows
    without a doc_id draw as one id does; repeated rows get equal outputs.  The columns named by carry come
    in a struct, carried; others are ignored.  Narrow: no shuffle.
    """
    return text_bytes(docs, carry).mapInArrow(lambda b: _rearranged(b, mix), with_carried(SCHEMA, docs, carry))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of.  Changed texts hold no mark of their own, so three marks divide
    an output into its parts."""
    parts = F.split(output, "|".join(MARKS), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
