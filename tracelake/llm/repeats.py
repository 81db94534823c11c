"""Removal of long repeats with a common-prefix interval tree.

Any SHORT bytes that repeat hold the same ANCHOR bytes at the same place: the
window's least hash picks them. Anchors that occur once are dropped by a plain
count. The rest are a sparse suffix array: for each anchor, Spark brings together
the suffixes that begin with it (one for each distinct surrounding), they are
sorted, and a stack scan over their common prefixes walks the interval tree. In
every interval, how far members agree to the left (their left-extension
diversity) gives the maximal repeats, with all of their occurrences.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import common as C

#: Bytes of a repeat that is removed, of one that is found at all (a passage of 50 words has about as many), and of an anchor.
LENGTH, SHORT, ANCHOR = 400, 300, 100
#: How far the surroundings of an anchor reach to either side, and how many of their bytes a repeat needs.
REACH, NEED = LENGTH - ANCHOR, SHORT - ANCHOR
#: Words of a passage.
PASSAGE_WORDS = 50
#: Distinct surroundings of an anchor that one task sorts; more go through counts of single windows.
GROUP = 65_536
#: Rows of surroundings that are compared with the one before at once.
COMPARED = 4096
_NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, op: np.ufunc, pad: np.uint64) -> np.ndarray:
    """op over x[i : i + width] for every i (pad past the end)."""
    n = len(x)
    blocks = -(-(n + width) // width)
    grid = np.full(blocks * width, pad, np.uint64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Positions of the anchors of all windows of SHORT bytes that lie within one text.

    Long texts go in pieces that overlap by all but one byte of a window.
    """
    if len(buf) <= 2 * piece:
        return _anchors(buf, offsets)
    found = []
    for lo in range(0, len(buf), piece):
        hi = min(len(buf), lo + piece + SHORT - 1)
        found.append(lo + _anchors(buf[lo:hi], np.unique(np.clip(offsets, lo, hi)) - lo))
    return np.unique(np.concatenate(found))


def _anchors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(buf) - ANCHOR + 1
    if len(buf) < SHORT:
        return np.zeros(0, np.int64)
    prefix = C.prefix_hash(buf)
    hashes = C.mix((prefix[ANCHOR:] - prefix[:n]) * C.powers(n)[1])
    least = _slide(hashes, NEED + 1, np.minimum, _NOTHING)
    inside = np.zeros(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= SHORT:
            inside[a : b - SHORT + 1] = True
    least[~inside] = 0
    # An anchor equals the least hash of some window that holds it.
    most = _slide(least[::-1], NEED + 1, np.maximum, np.uint64(0))[::-1]
    return np.flatnonzero(most == hashes)


_ANCHOR_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("left", pa.int16()), ("right", pa.int16()), ("times", pa.int32()), ("run", pa.int32()), ("anchor", pa.int64()), ("around", pa.int64())]
)
_ANCHOR_SQL = "doc_id long, text_key long, pos int, left smallint, right smallint, times int, run int, anchor long, around long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with the keys of their bytes and of what surrounds them.

    In periodic text one anchor with one surrounding comes again and again;
    overlapping ones of a text are one row, with their number (times) and the
    distance from the first to the last (run).
    """
    low = xxhash.xxh3_64_intdigest
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for lo, _, buf, offsets in C.slices(C.rows_of(batch, "text"), 1 << 19):
            at = anchors(buf, offsets)
            doc = np.searchsorted(offsets, at, "right") - 1
            begin, end = np.maximum(offsets[doc], at - REACH), np.minimum(offsets[doc + 1], at + LENGTH)
            view = memoryview(buf)
            key = np.array([low(view[p : p + ANCHOR]) for p in at.tolist()], np.uint64)
            # The seed tells apart equal bytes that lie differently around the anchor.
            around = np.array([low(view[a:b], seed=p - a + 1) for a, p, b in zip(begin.tolist(), at.tolist(), end.tolist(), strict=True)], np.uint64)
            order = np.lexsort((at, key, around, doc))
            at, doc, begin, end, key, around = (x[order] for x in (at, doc, begin, end, key, around))
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (around[1:] != around[:-1]) | (key[1:] != key[:-1]) | (begin[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            rows = pa.array(lo + doc[first])
            columns = (at - offsets[doc], at - begin, end - at - ANCHOR)
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), keys.take(rows), *(pa.array(c[first].astype(t)) for c, t in zip(columns, (np.int32, np.int16, np.int16), strict=True)), pa.array((last - first + 1).astype(np.int32)), pa.array((at[last] - at[first]).astype(np.int32)), pa.array(key[first].view(np.int64)), pa.array(around[first].view(np.int64))],
                schema=_ANCHOR_SCHEMA,
            )


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def prefix_intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an array of common-prefix lengths (common[i]: of suffixes i - 1 and i).

    Yields every interval of the tree, inner before outer: prefix length, first
    and last suffix.
    """
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now, begin = (common[i] if i < len(common) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            yield length, begin, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


class _RangeMin:
    def __init__(self, x: np.ndarray):
        self.rows = [x]
        k = 1
        while 2 * k <= len(x):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of x[lo:hi] (lo < hi)."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << int(k))])
        return out


def _walk(order: np.ndarray, common: np.ndarray, by_left: np.ndarray, steps: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Walks the interval tree of one anchor's suffixes.

    order sorts them by what follows, common holds the shared prefixes of
    neighbours in it (common[0] is 0); by_left and steps likewise for what comes
    before. Yields members, how far each agrees to the left with another member
    of the interval, and the interval's prefix.
    """
    if len(order) == 2:
        if steps[0] + common[1] >= need:
            yield order, np.array([steps[0], steps[0]]), int(common[1])
        return
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    widest, least = int(steps.max()), None
    for right, first, last in prefix_intervals(common.tolist()):
        if right + widest < need:
            continue
        least = least or _RangeMin(steps)
        ranks = np.sort(rank[order[first : last + 1]])
        near = least(ranks[:-1], ranks[1:])
        left = np.maximum(np.append(near, 0), np.append(0, near))
        # Members that agree with no other one far enough to the left have no long repeat here.
        far = left + right >= need
        if far.any():
            yield by_left[ranks[far]], left[far], right


def _classes(order: np.ndarray, common: np.ndarray, by_left: np.ndarray, steps: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Maximal repeats of one anchor's suffixes: members, their common bytes to the left and to the right.

    In an interval of the tree, members that agree to the left form intervals of
    their own; one is a class if its members don't all follow with one more
    equal byte, that is, if they lie in different children.
    """
    place, rank = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rank[by_left] = np.arange(len(order))
    ahead, beside = _RangeMin(common), _RangeMin(np.append(steps, 0))
    for right, first, last in prefix_intervals(common.tolist()):
        if right + REACH < need:
            continue
        ranks = np.sort(rank[order[first : last + 1]])
        near = beside(ranks[:-1], ranks[1:])
        for left, a, b in prefix_intervals([0, *near.tolist()]):
            if left + right >= need and a < b and near[a:b].min() == left:
                members = by_left[ranks[a : b + 1]]
                lo, hi = place[members].min(), place[members].max()
                if ahead(np.array([lo + 1]), np.array([hi + 1]))[0] == right:
                    yield members, left, right


def _sorted_side(sides: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings within their groups, and how many bytes each shares with the one before it in that order."""
    sizes = np.fromiter(map(len, sides), np.int64, len(sides))
    width = max(1, int(sizes.max()))
    wide = np.array(sides, f"S{width}")
    order = np.lexsort((sizes, wide, group))  # a shorter side is padded with zeros and comes first
    sizes, grid = sizes[order], wide.view(np.uint8).reshape(len(sides), width)
    same = np.zeros(len(sides), np.int64)
    # Some rows at a time, so that the bytes are held once and not a copy for each step.
    for a in range(1, len(sides), COMPARED):
        mine, before = grid[order[a : a + COMPARED]], grid[order[a - 1 : min(a + COMPARED, len(sides)) - 1]]
        differ = mine != before
        same[a : a + COMPARED] = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.append(0, np.minimum(same[1:], np.minimum(sizes[1:], sizes[:-1])))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], group: np.ndarray, need: int = NEED, walk: Callable = _walk) -> Iterator[tuple[np.ndarray, np.ndarray | int, int]]:
    """Repeats around the anchors of many groups (numbers, each group's rows together).

    Yields members (rows), how far each agrees to the left with another, and to
    the right with all; with walk=_classes how far all agree to the left. lefts
    are read outwards from the anchor (reversed), rights likewise. Only repeats
    of need bytes or more besides the anchor come out.
    """
    order, common = _sorted_side(rights, group)
    by_left, steps = _sorted_side(lefts, group)
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
        if b - a > 1:
            mine = common[a:b].copy()
            mine[0] = 0
            for members, left, right in walk(order[a:b] - a, mine, by_left[a:b] - a, steps[a + 1 : b], need):
                yield members + a, left, right


_SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0].slice(0, 0)


def _widest(spans: np.ndarray) -> np.ndarray:
    """Spans (suffix, begin, end) without those inside another one of the same suffix."""
    at, begin, end = spans[np.lexsort((-spans[:, 2], spans[:, 1], spans[:, 0]))].T
    # On one axis, suffix after suffix.
    reach = end + at * (int(end.max(initial=0)) + 1)
    keep = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])[: len(at)]
    return np.stack([at, begin, end], 1)[keep]


#: Spans of an interval tree that are held before those inside others are dropped.
HELD = 1 << 16


def _spans(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of suffixes that occur once; those inside others, which cover nothing more, are left out."""
    column = {n: rows.column(n) for n in rows.schema.names}
    alone = np.asarray(column["alone"].to_pylist(), bool)
    pos = column["pos"].to_numpy().astype(np.int64)
    found, held = [np.zeros((0, 3), np.int64)], 0
    for members, left, right in maximal_repeats(column["lefts"].to_pylist(), column["rights"].to_pylist(), column["anchor"].to_numpy()):
        own = alone[members]
        members = members[own]
        found.append(np.stack([members, pos[members] - left[own], pos[members] + ANCHOR + right], 1))
        held += len(members)
        # Nested intervals have the same members again: the tree's members are many times its suffixes.
        if held >= max(HELD, 2 * len(found[0])):
            found, held = [_widest(np.concatenate(found))], 0
    spans = _widest(np.concatenate(found))
    rows_of = pa.array(spans[:, 0])
    return pa.RecordBatch.from_arrays([column["doc_id"].take(rows_of), column["text_key"].take(rows_of), pa.array(spans[:, 1]), pa.array(spans[:, 2])], schema=_SPAN_SCHEMA)


_CLASS_SCHEMA = pa.schema([("group_id", pa.int64()), ("length", pa.int32()), ("anchor", pa.int64()), ("around", pa.int64()), ("before", pa.int32())])
_CLASS_SQL = "group_id long, length int, anchor long, around long, before int"


def _class_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Maximal repeats: the key of their bytes, their length, and for each member its surroundings and the bytes before its anchor.

    rights begin with the anchor here. Surroundings that come more than once are a repeat of their own.
    """
    anchor, around = rows.column("anchor").to_numpy(), rows.column("around").to_numpy()
    lefts, rights = rows.column("lefts").to_pylist(), rows.column("rights").to_pylist()
    out = [np.zeros((0, 5), np.int64)]
    again = np.flatnonzero(~np.asarray(rows.column("alone").to_pylist(), bool))
    leaves = ((np.array([k]), len(lefts[k]), len(rights[k])) for k in again.tolist())
    for members, left, right in itertools.chain(maximal_repeats(lefts, rights, anchor, SHORT, _classes), leaves):
        first = int(members[0])
        piece = lefts[first][:left][::-1] + rights[first][:right]
        # Where the anchor is picked by windows within the repeat, every occurrence has it, so that none is missed.
        if len(piece) < SHORT or left not in anchors(np.frombuffer(piece, np.uint8), np.array([0, len(piece)])):
            continue
        key = xxhash.xxh3_64_intdigest(piece)
        shared = np.full((len(members), 5), (np.uint64(key).astype(np.int64), left + right, 0, 0, left), np.int64)
        shared[:, 2], shared[:, 3] = anchor[members], around[members]
        out.append(shared)
    found = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(found[:, k]).cast(f.type) for k, f in enumerate(_CLASS_SCHEMA)], schema=_CLASS_SCHEMA)


def _by_anchor(solve: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """solve on whole anchors of rows sorted by anchor; a batch's last anchor waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch.column("anchor").to_numpy()
            if not len(names):
                continue
            cut = int(np.flatnonzero(names == names[-1])[0])
            if held and cut == 0 and held[-1].column("anchor")[-1].as_py() == names[0]:
                held.append(batch)
                continue
            whole = _one([*held, batch.slice(0, cut)])
            if whole.num_rows:
                yield solve(whole)
            held = [batch.slice(cut)]
        if held:
            yield solve(_one(held))

    return run


_CONTEXT_SCHEMA = pa.schema(
    [("anchor", pa.int64()), ("around", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("alone", pa.bool_()), ("lefts", pa.binary()), ("rights", pa.binary())]
)
_CONTEXT_SQL = "anchor long, around long, doc_id long, text_key long, pos int, alone boolean, lefts binary, rights binary"
#: Rows of a batch of surroundings, of about 600 bytes each.
STEP = 8192


def _contexts(with_anchor: bool):
    """What lies before (reversed) and after the suffixes to compare; with_anchor: after begins with the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, key, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "raw", "compare")), strict=True):
                    for f in found or []:
                        p = f["pos"]
                        after = text[p if with_anchor else p + ANCHOR : p + ANCHOR + f["right"]]
                        yield f["anchor"], f["around"], doc_id, key, p, f["alone"], text[p - f["left"] : p][::-1], after

        for some in itertools.batched(rows(), STEP):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _CONTEXT_SCHEMA, strict=True)], schema=_CONTEXT_SCHEMA)

    return run


_WINDOW_SCHEMA = pa.schema([("anchor", pa.int64()), ("window", pa.binary()), ("length", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int64()), ("alone", pa.bool_())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of LENGTH and of SHORT bytes around an anchor, by a 128-bit key with its place."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for anchor, doc_id, key, pos, alone, left, right in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "pos", "alone", "lefts", "rights")), strict=True):
                for length in (LENGTH, SHORT):
                    need = length - ANCHOR
                    for o in range(max(0, need - len(right)), min(need, len(left)) + 1):
                        window = left[:o] + b"|" + right[: need - o]
                        yield anchor, hashlib.blake2b(window, digest_size=16, salt=o.to_bytes(2, "big")).digest(), length, doc_id, key, pos - o, alone

    for some in itertools.batched(rows(), 4 * STEP):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _WINDOW_SCHEMA, strict=True)], schema=_WINDOW_SCHEMA)


def _class_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of SHORT bytes around an anchor as a member of the class of its bytes."""
    for batch in batches:
        out: list[tuple] = []
        for anchor, around, alone, left, right in zip(*(batch.column(c).to_pylist() for c in ("anchor", "around", "alone", "lefts", "rights")), strict=True):
            buf = np.frombuffer(left[::-1] + right, np.uint8)
            prefix, n = C.prefix_hash(buf), len(buf) - ANCHOR + 1
            hashes = C.mix((prefix[ANCHOR:] - prefix[:n]) * C.powers(n)[1])
            least = _slide(hashes, NEED + 1, np.minimum, _NOTHING)
            for o in range(max(0, SHORT - len(right)), min(NEED, len(left)) + 1):
                at = len(left) - o
                if least[at] == hashes[len(left)]:  # the window picks this anchor, and so it does wherever it comes
                    key = np.uint64(xxhash.xxh3_64_intdigest(buf[at : at + SHORT])).astype(np.int64)
                    out.append((key, SHORT, anchor, around, o, 1 if alone else 2))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*_CLASS_SCHEMA.types, pa.int32()), strict=True)], [*_CLASS_SCHEMA.names, "times"])


_CUT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_bytes", pa.binary()), ("passages", pa.list_(pa.list_(pa.int64())))]
)
_CUT_SQL = "doc_id long, n_bytes long, spans array<array<long>>, kept_bytes binary, passages array<array<long>>"


def _spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of a column of lists of (begin, end)."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten()
    known = np.asarray(column.is_valid().to_pylist(), bool)
    rows = np.repeat(np.arange(len(column)), np.where(known, sizes, 0))
    return rows, flat.field("begin").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64)


def _runs(row: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of maximal runs: overlapping or touching spans of a text are one."""
    order = np.lexsort((end, begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    # On one axis, with a gap between texts.
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    reach = np.maximum.accumulate(end + base[row])
    first = np.flatnonzero(np.append(True, begin[1:] + base[row[1:]] > reach[:-1]))
    last = np.append(first[1:], len(row)) - 1
    return row[first], begin[first], reach[last] - base[row[first]]


def _n_words(piece: bytes) -> int:
    inside = ~C.SPACE[np.frombuffer(piece, np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def _pairs(n: int, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where each of n rows' runs begin, and the runs as a column of lists."""
    at = np.searchsorted(row, np.arange(n + 1))
    pairs = pa.ListArray.from_arrays(np.arange(0, 2 * len(row) + 1, 2, dtype=np.int32), pa.array(np.stack([begin, end], 1).ravel()))
    return at, pa.ListArray.from_arrays(at.astype(np.int32), pairs)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("raw").to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        row, begin, end = (np.concatenate(x) for x in zip(_spans_of(batch.column("whole")), _spans_of(batch.column("more")), strict=True))
        long = end - begin >= LENGTH
        at, spans = _pairs(len(texts), *(removed := _runs(row[long], begin[long], end[long], sizes)))
        kept = []
        for k, text in enumerate(texts):
            edges = [0, *np.stack([x[at[k] : at[k + 1]] for x in removed[1:]], 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        runs = _runs(row, begin, end, sizes)
        worded = np.array([_n_words(texts[r][a:b]) >= PASSAGE_WORDS for r, a, b in zip(*(x.tolist() for x in runs), strict=True)], bool)
        _, passages = _pairs(len(texts), *(x[worded] for x in runs))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), spans, pa.array(kept, pa.binary()), passages], schema=_CUT_SCHEMA)


def _first() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "text_key", "pos")


def _repeated_anchors(docs: DataFrame, id_col: str, text_col: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts with their keys; anchors that occur again, marked mixed if their surroundings differ; and those surroundings (of every anchor, if wanted) with how often they come and where first."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = C.materialize(source.where(F.octet_length("text") >= SHORT).mapInArrow(_find_anchors, _ANCHOR_SQL))
    # Written first, so that the join has plain exchanges on both sides, whose hot keys adaptive execution can split.
    often = found.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("n > 1")
    often = C.materialize(often.select("anchor", (F.col("lo") < F.col("hi")).alias("mixed")))
    repeated = C.materialize(found.join(often, "anchor"))
    # One occurrence stands for all with the same surroundings.
    kinds = C.materialize(repeated.where(F.col("mixed") | F.lit(every)).groupBy("anchor", "around").agg(F.sum("times").alias("n"), F.min(_first()).alias("first")))
    return source, repeated, kinds


def _surroundings(source: DataFrame, repeated: DataFrame, kinds: DataFrame, with_anchor: bool = False) -> tuple[DataFrame, DataFrame]:
    """All texts with their spans (whole) and suffixes to compare, and the contexts of the latter."""
    marked = repeated.join(kinds, ["anchor", "around"], "left").withColumn("alone", F.col("n") == 1)
    whole = ~F.col("mixed") | (F.col("n") > 1)
    span = F.when(whole, F.struct((F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("run") + ANCHOR + F.col("right")).alias("end")))
    suffix = F.when(_first() == F.col("first"), F.struct("pos", "left", "right", "anchor", "around", "alone"))
    entries = marked.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), span.alias("w"), suffix.alias("c")).where("w IS NOT NULL OR c IS NOT NULL")
    by_text = entries.groupBy("d", "k").agg(F.collect_list("w").alias("whole"), F.collect_list("c").alias("compare"))
    joined = source.join(by_text, source.doc_id.eqNullSafe(by_text.d) & (source.text_key == by_text.k), "left")
    none = F.col("whole").isNull()
    split = C.materialize(
        joined.select(
            "doc_id",
            "text_key",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(none, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
            F.when(~none, F.col("text").cast("binary")).alias("raw"),
            "whole",
            "compare",
        )
    )
    contexts = split.where(F.size("compare") > 0).select("doc_id", "text_key", "raw", "compare").mapInArrow(_contexts(with_anchor), _CONTEXT_SQL)
    return split, contexts


def _parted(kinds: DataFrame, contexts: DataFrame, group: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of anchors that a task can sort, and those of all others (None if there are none)."""
    large = C.materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > group).select("anchor"))
    if not large.limit(1).count():
        return contexts, None
    contexts = C.materialize(contexts)
    return contexts.join(large, "anchor", "left_anti"), contexts.join(large, "anchor", "left_semi")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges), kept_bytes, passages for every row of docs.

    A byte goes if it lies in LENGTH bytes that also start somewhere else in the
    table, in the same text or another; overlapping repeats count, and texts are
    judged as they come in. passages are the runs of PASSAGE_WORDS words or more
    that SHORT bytes cover which start elsewhere, whether they go or not. Null
    text counts as empty; texts below SHORT bytes have no repeat. Rows that
    repeat a text of LENGTH bytes or more lose all of it. Cuts may fall within a
    character, hence bytes. An empty table gives no rows; only the two columns
    named are read, so others may have any name.
    """
    source, repeated, kinds = _repeated_anchors(docs, id_col, text_col)
    split, contexts = _surroundings(source, repeated, kinds)
    contexts, hot = _parted(kinds, contexts, group)
    spans = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_anchor(_spans), "doc_id long, text_key long, begin long, end long")
    if hot is not None:
        windows = hot.mapInArrow(_windows, "anchor long, window binary, length int, doc_id long, text_key long, begin long, alone boolean")
        twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
        windows = windows.where("alone").join(twice, ["anchor", "window"], "left_semi")
        spans = spans.unionByName(windows.select("doc_id", "text_key", "begin", (F.col("begin") + F.col("length")).alias("end")))
    edges = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct("begin", "end")).alias("more"))
    touched = split.where("whole IS NOT NULL").select("doc_id", "text_key", "raw", "whole", "compare")
    cut = touched.join(edges, touched.doc_id.eqNullSafe(edges.d) & (touched.text_key == edges.k), "left").select("doc_id", "raw", "whole", "more")
    done = cut.mapInArrow(_cut, _CUT_SQL).withColumn("sha", F.sha2("kept_bytes", 256))
    none = F.array().cast("array<array<long>>")
    plain = split.where("whole IS NULL").select("doc_id", "n_bytes", none.alias("spans"), F.lit(None).cast("binary").alias("kept_bytes"), none.alias("passages"), "sha")
    return done.unionByName(plain)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """group_id, length, doc_id, begin: the maximal repeats of SHORT bytes or more, each with all of its occurrences.

    The members of a group have the same bytes, and no further byte on either
    side is the same in all. What is compared reaches REACH bytes to either side
    of an anchor (around anchors with more than group surroundings, windows of SHORT bytes); pieces
    that the same members share at the same distance are joined to one group of any length. Only where more members than
    those of a group agree over all that is compared, it comes as parts on both sides of
    there. Text in short periods repeats itself at every length, so its groups' rows
    grow with the square of its length. Nulls, empty tables and other columns as in remove_repeats.
    """
    source, repeated, kinds = _repeated_anchors(docs, id_col, text_col, every=True)
    _, contexts = _surroundings(source, repeated, kinds, with_anchor=True)
    contexts, hot = _parted(kinds, contexts, group)
    classes = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_anchor(_class_rows), _CLASS_SQL)
    if hot is not None:
        windows = hot.mapInArrow(_class_windows, _CLASS_SQL + ", times int")
        twice = windows.groupBy("group_id").agg(F.sum("times").alias("n")).where("n > 1").select("group_id")
        classes = classes.unionByName(windows.join(twice, "group_id", "left_semi").drop("times"))
    # Texts in periods hold an anchor at even distances; each place is an occurrence.
    even = F.when(F.col("times") > 1, (F.col("run") / (F.col("times") - 1)).cast("int")).otherwise(1)
    places = repeated.withColumn("at", F.explode(F.sequence("pos", F.col("pos") + F.col("run"), even)))
    found = places.join(classes, ["anchor", "around"])
    return _joined(C.materialize(found.select("group_id", "length", "doc_id", (F.col("at") - F.col("before")).cast("long").alias("begin")).distinct()))


def _joined(members: DataFrame) -> DataFrame:
    """Groups that have the same members but for one shift, and that overlap or touch, as one (under the name of the first).

    Members are compared by two 64-bit keys over all of them and their number, which
    Spark combines before the shuffle; a text's groups with the same members are one
    window, and the members themselves move once.
    """
    heads = members.groupBy("group_id", "length").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "begin")).alias("head"))
    away = F.col("begin") - F.col("head.begin")
    keys = members.join(heads, ["group_id", "length"]).groupBy("group_id", "length", "head", "n")
    keys = keys.agg(F.bit_xor(F.xxhash64("doc_id", away)).alias("k1"), F.bit_xor(F.xxhash64(away, "doc_id", F.lit(1))).alias("k2"))
    alike = Window.partitionBy("head.doc_id", "n", "k1", "k2").orderBy("head.begin", F.desc("length"), "group_id")
    before = alike.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("head.begin") + F.col("length")
    runs = keys.withColumn("end", end).withColumn("new", F.coalesce((F.col("head.begin") > F.max("end").over(before)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(alike.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy("head.doc_id", "n", "k1", "k2", "run")
    first = runs.withColumn("whole", (F.max("end").over(whole) - F.min("head.begin").over(whole)).cast("int")).where("new = 1").select("group_id", "length", "whole")
    return members.join(first, ["group_id", "length"]).select("group_id", F.col("whole").alias("length"), "doc_id", "begin")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages of what remove_repeats returns."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return removed.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"))
