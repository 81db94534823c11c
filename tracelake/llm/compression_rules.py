"""Quality rules: word counts and zstandard compression bands.

What ratio is usual depends on the length: longer texts compress better. The
limits of each length are fitted on labelled good texts, as a centre and a
spread by half octaves of bytes; without labels, fixed bands hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C
from tracelake.operators import stats

#: Without fitted limits: from so many bytes on, the compression ratio must lie between low and high.
BANDS = ((0, 0.0, 2.2), (256, 1.15, 2.8), (512, 1.30, 3.2), (1024, 1.45, 3.6), (4096, 1.60, 4.0), (16384, 1.70, 4.4))
#: Bytes of a text's fixed chunks (the last one may be shorter), and the share of them that may lie outside the limits.
CHUNK, CHUNK_SHARE = 4096, 0.25
#: The fewest rows that count for a half octave, and how many spreads a ratio may lie off the centre.
LEAST_ROWS, SPREADS = 20, 4.0
LEVEL = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")] + [(c, pa.float64()) for c in ("ratio", "chunks_outside")] + [("inside", pa.bool_())]
)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[number] > 1


def _counts(buf: np.ndarray, offsets: np.ndarray, window: int) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, doc = C.words(buf, offsets)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    inside = ~C.SPACE[buf]
    n_words = np.bincount(doc, minlength=n)
    grams, first = C.word_grams(C.hash_ranges(buf, starts, ends), doc, window)
    again = _repeats(C.mix(grams + doc[first].astype(np.uint64) * C.STEPS[60]))
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[first[again]] += 1
    np.subtract.at(cover, first[again] + window, 1)
    repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    # Lines: a new one after each \n and at each text's start.
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    at = np.searchsorted(breaks, line_start)
    line_end = np.minimum(np.append(breaks, len(buf))[at], offsets[line_doc + 1])
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    keys = C.mix(C.hash_ranges(buf, line_start, line_end) + line_doc.astype(np.uint64) * C.STEPS[61])
    _, earliest = np.unique(keys, return_index=True)
    dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[earliest], minlength=n)
    return [n_words, total(inside & ((buf & 0xC0) != 0x80)), total(_SYMBOL[buf]), dup, repeat]


class Limits:
    """The least and greatest usual ratio of a text of so many bytes."""

    def __init__(self, octaves: np.ndarray, centres: np.ndarray, spreads: np.ndarray):
        self.octaves, self.centres, self.spreads = octaves, centres, spreads

    def __call__(self, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.octaves):
            low, high = np.zeros(len(n_bytes)), np.full(len(n_bytes), np.inf)
            for least, a, b in BANDS:
                low, high = np.where(n_bytes >= least, a, low), np.where(n_bytes >= least, b, high)
            return low, high
        # Straight lines between the half octaves; the outermost ones hold beyond.
        at = np.log2(np.maximum(n_bytes, 1))
        centre, spread = np.interp(at, self.octaves, self.centres), np.interp(at, self.octaves, self.spreads)
        # Where little was learned from shorter or longer texts, the limits there are wider.
        beyond = np.maximum(0, np.maximum(self.octaves[0] - at, at - self.octaves[-1]))
        width = SPREADS * spread * (1 + 2 * beyond) + 0.3 * beyond
        return centre - width, centre + width

    def inside(self, n_bytes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        low, high = self(n_bytes)
        return (ratio >= low) & (ratio <= high)


NO_LIMITS = Limits(*[np.zeros(0)] * 3)


def _ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for lo, hi, buf, offsets in C.slices(C.rows_of(batch, "text")):
            view = memoryview(buf)
            sizes = np.diff(offsets)
            packed = np.array([len(pack.compress(view[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), pa.array(sizes / packed)], ["doc_id", "n_bytes", "ratio"])


def fit_limits(docs: DataFrame, good_ids: DataFrame) -> Limits:
    """Limits from all texts of docs (doc_id, text) whose doc_id is in good_ids.

    For each half octave of bytes with LEAST_ROWS texts or more, the centre is
    the median ratio and the spread what the quartiles' distance is in a normal
    law; quantiles are exact, and no task holds all of a half octave. At most 128 rows come to the driver.
    Null ids and texts teach nothing; without enough rows the fixed bands hold.
    """
    chosen = good_ids.where("doc_id IS NOT NULL").select("doc_id").distinct()
    texts = docs.where(F.octet_length("text") > 0).select("doc_id", "text")
    half = F.floor(2 * F.log2("n_bytes")).alias("half")
    # Every text is packed where it is read, so that the join moves three numbers a row and no text.
    packed = texts.mapInArrow(_ratio, f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, ratio double").join(chosen, "doc_id", "left_semi")
    # Written once: the quantiles read it three times.
    ratios = C.materialize(packed.select(half, "n_bytes", "ratio"))
    at = ratios.groupBy("half").agg(F.avg(F.log2("n_bytes")).alias("at"))
    found = stats.quantiles(ratios, "ratio", {"low": 0.25, "middle": 0.5, "high": 0.75}, ["half"]).join(at, "half")
    known = sorted(tuple(r) for r in found.where(F.col("n") >= LEAST_ROWS).select("at", "low", "middle", "high").collect())
    if not known:
        return NO_LIMITS
    at, low, middle, high = (np.array(x) for x in zip(*known, strict=True))
    return Limits(at, middle, np.maximum((high - low) / 1.349, 0.01))


def _measure(window: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.rows_of(batch, "text")):
                sizes = np.diff(offsets)
                whole, outside = np.zeros(hi - lo), np.zeros(hi - lo)
                view = memoryview(buf)
                for k in np.flatnonzero(sizes).tolist():
                    text = view[offsets[k] : offsets[k + 1]]
                    whole[k] = len(text) / len(pack.compress(text))
                    if len(text) > CHUNK:
                        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
                        lengths = np.array([len(c) for c in chunks])
                        outside[k] = 1 - limits.inside(lengths, lengths / np.array([len(pack.compress(c)) for c in chunks])).mean()
                counts = _counts(buf, offsets, window)
                inside = limits.inside(sizes, whole)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, (*counts, sizes, whole, outside, inside))], schema=_SCHEMA)

    return run


def quality_rules(docs: DataFrame, limits: Limits = NO_LIMITS, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """Counts, ratios and verdict for every row of docs.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ratio (bytes
    over compressed bytes, 0 for empty text), chunks_outside (share of the
    4096-byte chunks, the shorter last one too, outside the limits of their
    lengths; 0 for texts of one chunk), inside (ratio within the limits of the
    text's length); base_failed, and kept: not base_failed, inside, and at most
    CHUNK_SHARE of the chunks outside. Null text counts as empty: no words, so
    it fails. Rows are judged alone and whole, so repeated rows have equal
    results; an empty table gives no rows. Only the two columns named are read,
    so others may have any name.
    """
    types = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    schema = ", ".join(f"{f.name} {types[f.type]}" for f in _SCHEMA)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure(window, limits), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("inside") & (F.col("chunks_outside") <= CHUNK_SHARE))
