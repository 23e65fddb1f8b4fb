"""Quality rules: counts of words, symbols, repeated lines and phrases, and compression bands.

The verdict adds zstandard ratios (bytes over compressed bytes) to two plain word rules.  Text that
shrinks too well is repetitive, text that hardly shrinks is noise; the limits depend on the length,
as longer texts compress better.  Fixed chunks catch a repetitive or random stretch that a long
document would average out.

The lower limits stand between noise and ordinary text of a length: words of random base64 have
ratios of up to 1.21 at 400 bytes, 1.40 at 1 KiB and 1.49 at 16 KiB, and of random base32 1.60 at 4 KiB;
ordinary text has 1.34 below 512 bytes, 1.42 from 1 KiB, 1.58 from 2 KiB and 1.79 from 4 KiB on at
least.  Random hex (1.6 to 1.9) lies among ordinary text, so no ratio can tell it apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logquarry.llm.tables import text_bytes, with_carried

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: (bytes from which the band holds, least ratio, greatest ratio) of whole documents.
WHOLE_BANDS = (
    (0, 1.18, 3.4), (256, 1.22, 3.4), (384, 1.26, 3.4), (512, 1.36, 3.4), (768, 1.38, 3.4), (1024, 1.42, 4.0), (2048, 1.5, 4.0), (4096, 1.7, 4.6), (16384, 1.7, 5.2),
)
#: Bytes of a chunk, and bands of chunks by their bytes; a last one has half to one and a half of that.
CHUNK, CHUNK_BANDS = 4096, ((2048, 1.5, 4.4), (4096, 1.7, 4.4))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, least_chunk_ratio double, "
    "greatest_chunk_ratio double, verdict string"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, total, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def _ratio(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(data) / len(packer.compress(data))


def _band(bands: tuple, size: int) -> tuple[float, float]:
    """Least and greatest ratio of size bytes."""
    return next((a, b) for start, a, b in reversed(bands) if size >= start)


def chunks_of(data: bytes) -> list[bytes]:
    """All of data in chunks; a rest below half a chunk belongs to the one before it.  Shorter data is one
    chunk from half of one on, and is judged as a whole only below that."""
    starts = list(range(0, max(len(data) - CHUNK // 2, 0) + 1, CHUNK)) if len(data) >= CHUNK // 2 else []
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


def judge(data: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA after doc_id for one text."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    word_chars = len(data.translate(None, BLANKS).decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    whole = low = high = None
    verdict = "few words" if n < 50 else "repeated phrases" if failed else "kept"
    if data:
        whole = _ratio(data, packer)
        chunks = chunks_of(data)
        ratios = [_ratio(c, packer) for c in chunks]
        bands = [_band(CHUNK_BANDS, len(c)) for c in chunks]
        low, high = (min(ratios), max(ratios)) if ratios else (None, None)
        least, most = _band(WHOLE_BANDS, len(data))
        if not failed:
            if whole > most or any(r > b for r, (_, b) in zip(ratios, bands)):
                verdict = "repetitive"
            elif whole < least or any(r < a for r, (a, _) in zip(ratios, bands)):
                verdict = "incompressible"
    dup_lines = len(lines) - len(set(lines))
    return n, word_chars, symbols, dup_lines, repeats, failed, verdict == "kept", len(data), whole, low, high, verdict


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.string()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        rows = [judge(text or b"", packer) for text in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=names + batch.schema.names[2:])


def quality(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text), with its counts, ratios, verdict and kept.

    The columns named by carry are passed on in a struct, carried.
    A null text counts as empty; an empty text has no words and fails.  Repeated rows are judged each
    by itself, null ids are passed on, further columns are ignored.  Narrow: no shuffle.
    """
    return text_bytes(docs, carry).mapInArrow(_judged, with_carried(SCHEMA, docs, carry))
