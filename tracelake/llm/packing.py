"""Packing texts' ids into sequences by non-negative least squares over a histogram of lengths.

Texts are cut into windows, and lengths counted in steps. All combinations of
up to three lengths that fill a window are the columns of a least-squares problem: how often
must each be used, at least 0 times, to take up the histogram? The
repeat counts are rounded. What they leave over is packed greedily, the largest
length first, again whole combinations with repeat counts; a gap that no length
fits is filled by cutting a piece. The plan is a small table of ranks within
each length, so its size doesn't depend on the number of texts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import common as C

#: Ids of a sequence, of a step in which lengths are counted, and of a gap that is worth a cut; the id that ends each text.
WINDOW, STEP, LEAST_CUT, END_ID = 2048, 8, 64, 1
#: Distinct chunks and ids of them that a worker keeps from block to block, and from task to task, and bytes of text in a block.
TABLE_CHUNKS, TABLE_IDS, BLOCK_BYTES = 500_000, 4_000_000, 2 << 20

# -- ids ----------------------------------------------------------------------------------------

# The vocabulary's rule for chunks, over characters whose classes no version of Unicode has changed.
_SPACES = "\t-\r "
_CHUNK = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_SPACES}A-Za-z0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Latin letters with marks are U+00C0 to U+024F but for two signs; U+00AA, U+00B5 and U+00BA are letters too.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-\u024f"
_DIGITS = "0-9²³¹¼-¾"
_WIDE_SPACES = "\t-\r \u0085\u00a0"
_WIDE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_WIDE_SPACES}{_LETTERS}{_DIGITS}]+|[{_WIDE_SPACES}]+(?![^{_WIDE_SPACES}])|[{_WIDE_SPACES}]+")
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac\ufffd]")


@lru_cache(maxsize=2)
def _library(path: str):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True  # their names in a text are ordinary text
    return library


def chunks_of(text: str) -> list[str]:
    """Chunks that no merge crosses; a text with characters beyond Latin stays whole and is the library's to cut."""
    if text.isascii():
        return _CHUNK.findall(text)
    return [text] if _OTHER.search(text) else _WIDE.findall(text)


def _byte_names() -> list[str]:
    """The vocabulary's character for each byte: printable ones of Latin-1 are their own, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_NAMES = dict(enumerate(_byte_names()))
_SPACE = _NAMES[32]


class IdTable:
    """Ids of each distinct chunk seen so far, back to back; chunk 0 is the end of a text."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.model = self.library.model
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str | None, int] = defaultdict(count().__next__)
        self.number[None]
        self.ids = np.array([END_ID], np.int32)
        self.begin = np.array([0, 1], np.int64)

    def _found(self, chunk: str) -> list[int]:
        # A chunk is not to be cut again, so it goes to the library's model at once, spelled in its characters.
        if chunk.isascii() and chunk.isprintable():
            return [t.id for t in self.model.tokenize(chunk.replace(" ", _SPACE))]
        if _OTHER.search(chunk):
            return self.library.encode(chunk, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(_NAMES))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their ids, each text's end included."""
        if len(self.number) > TABLE_CHUNKS or len(self.ids) > TABLE_IDS:
            self.clear()
        cut = [chunks_of(t) for t in texts]
        for chunks in cut:
            chunks.append(None)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        known = len(self.number)
        rows = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if len(self.number) > known:
            found = [self._found(c) for c in islice(self.number, known, None)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        sizes = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.concatenate([[0], ends])[np.cumsum(np.append(0, counts))], self.ids[at]


@lru_cache(maxsize=1)
def _table(path: str) -> IdTable:
    return IdTable(path)


def _windows(path: str, keep: list[str], window: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        table, seen, part = _table(path), np.zeros(window // step + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            texts = C.rows_of(batch, "__tl_text")
            for lo, hi, _, _ in C.slices(texts, BLOCK_BYTES):
                offsets, ids = table.encode(texts.slice(lo, hi - lo).to_pylist())
                total = np.diff(offsets)
                pieces = -(-total // window)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(window, total[doc] - start)
                size = -(-length // step)
                # A piece's rank among those of its size in this partition.
                order = np.argsort(size, kind="stable")
                counts = np.bincount(size, minlength=len(seen))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[doc] + start, offsets[-1]), pa.int32()), pa.array(ids))
                columns = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(start), pa.array(length), pa.array(total[doc]), pa.array(size.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), lists],
                    [*keep, "start", "length", "doc_tokens", "__tl_size", "__tl_part", "__tl_rank", "ids"],
                )

    return run


# -- the plan -----------------------------------------------------------------------------------


def combinations(top: int) -> np.ndarray:
    """All ways to fill top by one, two or three sizes, ascending; unused places are 0."""
    two = np.stack([np.zeros(top // 2, np.int64), np.arange(1, top // 2 + 1), top - np.arange(1, top // 2 + 1)], 1)
    a, b = np.meshgrid(np.arange(1, top // 3 + 1), np.arange(1, top // 2 + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    three = np.stack([a, b, top - a - b], 1)[(a <= b) & (b <= top - a - b)]
    return np.concatenate([[[0, 0, top]], two, three])


def repeats(ways: np.ndarray, histogram: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often to use each way: the non-negative x with the least weighted squared distance between its sum of ways and the histogram.

    An active-set method: the way with the steepest descent joins; where the least
    squares of those that take part turn negative, the step ends at 0 and that way leaves.
    """
    scale = np.where(np.arange(len(histogram)) > 0, weight, 0.0)
    target = histogram * scale
    x = np.zeros(len(ways))
    active: list[int] = []
    column = lambda j: np.bincount(ways[j], minlength=len(histogram)) * scale
    matrix = np.zeros((len(histogram), 0))
    left = target.copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max())) * float(scale.max())
    for _ in range(4 * len(histogram)):
        slope = (left * scale)[ways].sum(1)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active.append(j)
        matrix = np.column_stack([matrix, column(j)])
        while active:
            gram = matrix.T @ matrix
            best = np.linalg.solve(gram + 1e-11 * np.trace(gram) / len(active) * np.eye(len(active)), matrix.T @ target)
            if best.min() > 0:
                x[active] = best
                break
            now = x[active]
            falls = best <= 0
            share = np.min(now[falls] / np.maximum(now[falls] - best[falls], 1e-300))
            moved = now + share * (best - now)
            x[active] = moved
            stays = ~(falls & (moved <= 1e-12 * max(1.0, moved.max())))
            if stays.all():
                stays[int(np.argmin(np.where(falls, moved, np.inf)))] = False
            x[[a for a, s in zip(active, stays, strict=True) if not s]] = 0
            active = [a for a, s in zip(active, stays, strict=True) if s]
            matrix = matrix[:, stays]
        left = target - matrix @ x[active]
    return x


@dataclass
class Plan:
    """Where ranks go. Each row: pieces of a size, ranks from low to high (excluded), which in turn go from first on into sequences, at a place in them.

    cut is how many cuts the pieces have had before; of each piece the ids from
    begin to end (0: all the rest) are meant.
    """

    rows: np.ndarray  # cut, size, low, high, begin, end, first, place

    def __post_init__(self) -> None:
        self.rows = self.rows[np.lexsort((self.rows[:, 2], self.rows[:, 1], self.rows[:, 0]))]

    def find(self, cut: int, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The row for each piece, or -1."""
        rows = self.rows[self.rows[:, 0] == cut]
        base = int(np.searchsorted(self.rows[:, 0], cut))
        if not len(rows):
            return np.full(len(size), -1)
        found = np.empty(len(size), np.int64)
        for s in np.unique(size):
            here = np.flatnonzero(size == s)
            first, last = np.searchsorted(rows[:, 1], [s, s + 1])
            at = first + np.searchsorted(rows[first:last, 2], rank[here], "right") - 1
            good = at >= first
            good[good] = rank[here][good] < rows[at[good], 3]
            found[here] = np.where(good, base + at, -1)
        return found


class _Pool:
    """Pieces that are still to be placed, by size in steps: ranges of ranks."""

    def __init__(self, histogram: np.ndarray):
        self.count = histogram.copy()
        self.ranges = [deque([[0, s, 0, int(n), 0]] if n else []) for s, n in enumerate(histogram)]
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0

    def take(self, size: int, times: int, first: int, place: int, head: int, step: int) -> None:
        """Puts times pieces of a size, or only their first head steps, at a place of the sequences from first on."""
        self.count[size] -= times
        while times:
            cut, own, low, high, begin = top = self.ranges[size][0]
            n = min(times, high - low)
            self.rows.append((cut, own, low, low + n, begin, begin + head * step if head else 0, first, place))
            if head:
                self.ranges[size - head].append([cut + 1, own, low, low + n, begin + head * step])
                self.count[size - head] += n
            top[2] += n
            if top[2] == high:
                self.ranges[size].popleft()
            first, times = first + n, times - n

    def use(self, sizes: list[tuple[int, int]], times: int, step: int) -> None:
        """times sequences of the given (size, head)."""
        for place, (size, head) in enumerate(sizes):
            self.take(size, times, self.sequences, place, head, step)
        self.sequences += times


def make_plan(histogram: np.ndarray, window: int = WINDOW, step: int = STEP, least_cut: int = LEAST_CUT) -> Plan:
    """The plan for histogram[s] pieces of s steps, s from 1 to window / step."""
    top = window // step
    pool = _Pool(histogram.astype(np.int64))
    ways = combinations(top)
    wanted = np.rint(repeats(ways, histogram.astype(float), np.arange(top + 1, dtype=float)))
    for j in np.flatnonzero(wanted)[np.argsort(-wanted[np.flatnonzero(wanted)], kind="stable")]:
        sizes, need = np.unique(ways[j][ways[j] > 0], return_counts=True)
        times = int(min(wanted[j], (pool.count[sizes] // need).min()))
        if times > 0:
            pool.use([(int(s), 0) for s in ways[j][::-1] if s], times, step)
    while pool.count.any():
        left, sizes, gap = pool.count.copy(), [], top
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            longer = np.flatnonzero(left)
            if len(fits):
                sizes.append((int(fits[-1]), 0))
            elif gap * step >= least_cut and len(longer):
                sizes.append((int(longer[-1]), gap))
            else:
                break
            left[sizes[-1][0]] -= 1
            gap -= sizes[-1][1] or sizes[-1][0]
        used, need = np.unique([s for s, _ in sizes], return_counts=True)
        pool.use(sizes, int((pool.count[used] // need).min()), step)
    return Plan(np.array(pool.rows, np.int64).reshape(-1, 8))


def _place(plan: Plan, keep: list[str], with_ids: bool):
    cuts = int(plan.rows[:, 0].max()) if len(plan.rows) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            start, length, size, rank = (take(c) for c in ("start", "length", "__tl_size", "__tl_rank"))
            lists = batch.column("ids")
            offsets, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values).astype(np.int32, copy=False)
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            for cut in range(cuts + 1):
                row = plan.find(cut, size, rank)
                piece = np.flatnonzero(row >= 0)
                if not len(piece):
                    break
                _, _, low, _, begin, end, first, place = plan.rows[row[piece]].T
                end = np.where(end > 0, end, length[piece])
                a, b = offsets[piece] + begin, offsets[piece] + end
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(piece))
                at = pa.array(piece)
                columns = [*(batch.column(c).take(at) for c in keep), pa.array(start[piece] + begin), pa.array(end - begin), pa.array(crc), batch.column("doc_tokens").take(at), pa.array(first + rank[piece] - low), pa.array(place)]
                names = [*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "__tl_place"]
                if with_ids:
                    own = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(b - a)), pa.int32()), pa.array(flat[own])))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", window: int = WINDOW, step: int = STEP, least_cut: int = LEAST_CUT, with_ids: bool = False) -> DataFrame:
    """The pieces of all docs: the keep columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for.

    A text's ids are the library's (file path, which every executor must have), names of special tokens taken
    as text, and then END_ID; null text counts as empty and has that id alone.
    A piece is ids start to start + length of its text; pieces of a text
    cover it once. sequence_id counts from 0 without gaps, offset is the piece's
    place there. Texts longer than the window are cut at its multiples; other
    cuts are made only to fill a gap of least_cut ids or more that no piece fits. Repeated rows are packed
    each for itself; an empty table gives no rows; the new columns take the
    place of kept ones of the same name.

    A length that step doesn't divide takes a step more in the plan: up to step - 1 ids of padding for a piece.
    To the driver comes the histogram (window / step counts).
    """
    if window % step or least_cut < step:
        raise ValueError("step must divide window, and least_cut be a step at least")
    types = dict(docs.dtypes)
    made = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    keep = [c for c in keep if c not in made]
    kept = [f"`{c}` {types[c]}" for c in keep]
    text = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__tl_text"))
    pieces = C.materialize(text.mapInArrow(_windows(path, keep, window, step), ", ".join([*kept, "start long", "length long", "doc_tokens long", "__tl_size int", "__tl_part int", "__tl_rank long", "ids array<int>"])))
    counts = C.materialize(pieces.groupBy("__tl_size", "__tl_part").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window // step + 1, np.int64)
    for r in counts.groupBy("__tl_size").agg(F.sum("n").alias("n")).collect():
        histogram[r["__tl_size"]] = r.n
    plan = make_plan(histogram, window, step, least_cut)
    earlier = Window.partitionBy("__tl_size").orderBy("__tl_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__tl_size", "__tl_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__tl_before"))
    ranked = pieces.join(before, ["__tl_size", "__tl_part"]).select(
        *[F.col(f"`{c}`") for c in keep], "start", "length", "doc_tokens", "__tl_size", (F.col("__tl_rank") + F.col("__tl_before")).alias("__tl_rank"), "ids"
    )
    schema = ", ".join([*kept, "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "__tl_place long", *(["ids array<int>"] if with_ids else [])])
    placed = ranked.mapInArrow(_place(plan, keep, with_ids), schema)
    within = Window.partitionBy("sequence_id").orderBy("__tl_place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")
    return placed.select(*[F.col(f"`{c}`") for c in keep], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(["ids"] if with_ids else []))
