"""Product codes of vectors, their codebooks learned by the filtering form of Lloyd's rounds.

Every block of a partition gets one kd-tree for each part of its vectors, whose
nodes hold their box, count and sum; the trees are built once and written to
the shared folder. A round walks them level by level: an entry that is farther
than the one nearest to the box's middle over the whole box drops out, and a
node that is left with one entry goes to it as a whole, by its cached sum and
count. All sums are of integers, so no order of blocks changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Points of a leaf at most, and components of a block.
LEAF, BLOCK = 16, 1 << 19


def _ends(n: int) -> list[np.ndarray]:
    """The bounds of the nodes of each level: halves, until no node has more than LEAF points."""
    levels = [np.array([0, n], np.int64)]
    while np.diff(levels[-1]).max() > LEAF:
        b = levels[-1]
        out = np.empty(2 * len(b) - 1, np.int64)
        out[::2], out[1::2] = b, (b[1:] + b[:-1]) // 2
        levels.append(out)
    return levels


@dataclass
class Tree:
    """Points in the order of the leaves, and box and sum of every node, level by level."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def grow(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of the points (at least one) in the tree, and the tree: each node is halved along its widest side."""
    n = len(points)
    order = np.arange(n)
    low, high, sums = [], [], []
    levels = _ends(n)
    for k, bounds in enumerate(levels):
        p, starts = points[order], bounds[:-1]
        low.append(np.minimum.reduceat(p, starts))
        high.append(np.maximum.reduceat(p, starts))
        sums.append(np.add.reduceat(p, starts))
        if k + 1 < len(levels):
            node = np.repeat(np.arange(len(starts)), np.diff(bounds))
            side = (high[-1] - low[-1]).argmax(1)[node]
            value = p[np.arange(n), side] - low[-1][node, side]
            order = order[np.argsort(node * (int(value.max()) + 1) + value, kind="stable")]
    return order, Tree(points[order], np.concatenate(low), np.concatenate(high), np.concatenate(sums))


def _least(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The position of the first least value of each run of the given sizes (none empty)."""
    starts = np.cumsum(sizes) - sizes
    hit = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, starts), sizes))
    run = np.repeat(np.arange(len(sizes)), sizes)[hit]
    return hit[np.append(True, run[1:] != run[:-1])] if len(hit) else hit


def descend(tree: Tree, book: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, int]]:
    """What the entries of book own: whole nodes (True, numbers in their level, entries, level), then single points.

    An entry stays a node's candidate unless it is farther than the star (the
    candidate nearest to the box's middle) from each place in the box, or as far
    at one place and of a higher index. The difference of the two squared
    distances is linear, so a corner of the box decides.
    """
    levels = _ends(len(tree.points))
    norm = (book**2).sum(1)
    nodes, sizes, entry = np.zeros(1, np.int64), np.array([len(book)]), np.arange(len(book))
    for level, bounds in enumerate(levels):
        if not len(nodes):
            return
        at = nodes + len(bounds) - 2  # 2**level - 1 nodes come before
        low, high = np.repeat(tree.low[at], sizes, 0), np.repeat(tree.high[at], sizes, 0)
        star = np.repeat(entry[_least(((2 * book[entry] - low - high) ** 2).sum(1), sizes)], sizes)
        apart = book[entry] - book[star]
        least = norm[entry] - norm[star] - 2 * (np.where(apart > 0, high, low) * apart).sum(1)
        stays = (least < 0) | ((least == 0) & (entry <= star))
        sizes = np.add.reduceat(stays.astype(np.int64), np.cumsum(sizes) - sizes)
        entry = entry[stays]
        alone = sizes == 1
        yield True, nodes[alone], entry[np.repeat(alone, sizes)], level
        entry, nodes, sizes = entry[np.repeat(~alone, sizes)], nodes[~alone], sizes[~alone]
        if level + 1 < len(levels):
            first = np.cumsum(sizes) - sizes
            twice = np.repeat(sizes, 2)
            entry = entry[np.repeat(np.repeat(first, 2) - (np.cumsum(twice) - twice), twice) + np.arange(int(twice.sum()))]
            nodes, sizes = (2 * nodes[:, None] + [0, 1]).ravel(), twice
    if len(nodes):
        held = levels[-1][nodes + 1] - levels[-1][nodes]
        pairs = held * sizes
        within = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        each = np.repeat(sizes, pairs)
        point = np.repeat(levels[-1][nodes], pairs) + within // each
        choice = entry[np.repeat(np.cumsum(sizes) - sizes, pairs) + within % each]
        best = _least(((tree.points[point] - book[choice]) ** 2).sum(1), np.repeat(sizes, held))
        yield False, point[best], choice[best], len(levels) - 1


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry owns, and their sums."""
    n, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    levels = _ends(len(tree.points))
    for whole, at, entry, level in descend(tree, book):
        np.add.at(n, entry, np.diff(levels[level])[at] if whole else 1)
        np.add.at(sums, entry, tree.sums[at + len(levels[level]) - 2] if whole else tree.points[at])
    return n, sums


def owners(tree: Tree, book: np.ndarray) -> np.ndarray:
    """The entry of each point, in the tree's order."""
    out = np.empty(len(tree.points), np.int64)
    levels = _ends(len(tree.points))
    for whole, at, entry, level in descend(tree, book):
        if whole:
            begin, size = levels[level][at], np.diff(levels[level])[at]
            out[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.repeat(entry, size)
        else:
            out[at] = entry
    return out


# -- blocks of trees ----------------------------------------------------------------------------


def _limit(width: int) -> int:
    """Largest component for which a squared distance of whole vectors, doubled, fits 63 bits."""
    return 1 << ((62 - max(1, width).bit_length()) // 2 - 1)


def whole_parts(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """The integers floor(scale * x) as rows, parts, components; zeros fill up a length that parts don't divide."""
    n, d = vectors.shape
    width = max(1, -(-d // parts))
    bound = _limit(parts * width)
    out = np.zeros((n, parts * width), np.int64)
    out[:, :d] = np.clip(np.floor(vectors.astype(np.float64) * scale), -bound, bound)
    return out.reshape(n, parts, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel(), kind))


def _plant(keep: list[str], parts: int, scale: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK // max(1, length))
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                n = part.num_rows
                values = part.column("__tl_vector").flatten().to_numpy(zero_copy_only=False)
                points = whole_parts(values.reshape(n, length), parts, scale)
                grown = [grow(points[:, p]) for p in range(parts)]
                ends = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.ListArray.from_arrays(ends, part.column(c)) for c in keep),
                        pa.array([n], pa.int32()),
                        _lists(np.stack([order for order, _ in grown]), pa.int32()),
                        *(_lists(np.stack([getattr(tree, what) for _, tree in grown]), kind) for what, kind in (("points", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("sums", pa.int64()))),
                    ],
                    [*keep, "__tl_n", "__tl_order", "__tl_points", "__tl_low", "__tl_high", "__tl_sums"],
                )

    return run


def _trees(batch: pa.RecordBatch, row: int, parts: int, width: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """Order and tree of each part of one block."""
    take = lambda c, *shape: np.asarray(batch.column(c)[row].values).astype(np.int64).reshape(parts, -1, *shape)
    order = take("__tl_order")
    arrays = [take(c, width) for c in ("__tl_points", "__tl_low", "__tl_high", "__tl_sums")]
    for p in range(parts):
        yield order[p], Tree(*(a[p] for a in arrays))


def _round(book: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, (_, tree) in enumerate(_trees(batch, row, book.shape[0], book.shape[2])):
                    more, total = totals(tree, book[p])
                    n[p] += more
                    sums[p] += total
        part, entry = np.nonzero(n)
        flat = sums[part, entry]
        ends = np.arange(len(part) + 1, dtype=np.int32) * book.shape[2]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], ["part", "entry", "n", "total"])

    return run


def _codes(book: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("__tl_n")[row].as_py()
                code, error = np.empty((n, book.shape[0]), np.uint8), np.zeros(n, np.int64)
                for p, (order, tree) in enumerate(_trees(batch, row, book.shape[0], book.shape[2])):
                    own = owners(tree, book[p])
                    code[order, p] = own
                    error[order] += ((tree.points - book[p][own]) ** 2).sum(1)
                digits = code.tobytes().hex()
                size = 2 * book.shape[0]
                texts = [digits[k * size : k * size + size] for k in range(n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[row].values for c in keep), pa.array(texts, pa.string()), pa.array(error)], [*keep, "code", "error"])

    return run


def encode_vectors(
    df: DataFrame, keep: tuple[str, ...] = ("vec_id", "label"), id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """The keep columns, code string and error long of every row with a finite vector; and the codebooks (part, entry, component).

    Rows go whose vector is null or holds null, NaN or infinity. Each codebook
    begins with the parts of the first rows by id (null ids last, ties by the
    vector); fewer rows than entries make a smaller book. The first row's
    length is the table's: rows of another length keep their place with
    null code and error; a length that parts don't divide, 0 included, is filled up
    with zeros. Components beyond 2**27 at 64 components (fewer bits for longer vectors) count as that.
    Repeated rows are rows of their own, with equal codes; an empty table gives no
    rows and empty codebooks. New columns take the place of kept ones called code or error.

    To the driver come the first rows, and for each round parts * entries sums:
    bounded by the two parameters and the vectors' length.
    """
    if entries > 256:
        raise ValueError("a code is two hex digits: 256 entries at most")
    keep = [c for c in keep if c not in ("code", "error")]
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = df.where(vector.isNotNull() & finite)
    seeds = [r.v for r in rows.orderBy(F.asc_nulls_last(f"`{id_col}`"), vector).limit(entries).select(vector.alias("v")).collect()]
    types = dict(df.dtypes)
    kinds = [f"`{c}` {types[c]}" for c in keep]
    coded = ", ".join([*kinds, "code string", "error long"])
    if not seeds:
        return df.sparkSession.createDataFrame([], coded), np.zeros((parts, 0, 1), np.int64)
    length = len(seeds[0])
    book = whole_parts(np.array([v for v in seeds if len(v) == length], np.float64).reshape(-1, length), parts, scale).transpose(1, 0, 2).copy()
    lists = ", ".join([*(f"`{c}` array<{types[c]}>" for c in keep), "__tl_n int", *(f"__tl_{c} array<{'long' if c == 'sums' else 'int'}>" for c in ("order", "points", "low", "high", "sums"))])
    own = [F.col(f"`{c}`") for c in keep]
    fit = rows.where(F.size(vector) == length)
    trees = C.materialize(fit.select(*own, vector.alias("__tl_vector")).mapInArrow(_plant(keep, parts, scale, length), lists))
    for _ in range(rounds):
        found = trees.mapInArrow(_round(book), "part int, entry int, n long, total array<long>")
        sums = [F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(book.shape[2])]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            book[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
    done = trees.mapInArrow(_codes(book, keep), coded)
    odd = rows.where(F.size(vector) != length).select(*own, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return done.unionByName(odd), book


def books_digest(book: np.ndarray) -> str:
    """sha256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of vectors (vec_id, embedding, label) that encode_vectors keeps.

    label_error sums the errors of equal labels, null labels together; a sum
    beyond 63 bits is null.
    """
    codes, book = encode_vectors(vectors)
    codes = C.materialize(codes)
    sums = codes.groupBy(F.col("label").alias("__tl_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("__tl_label"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(book)).alias("codebooks_sha256"))


def code_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int = 4) -> str:
    """DuckDB SQL for code_table() over vectors of parts * width components."""
    x = [f"x{k}" for k in range(width)]
    apart = " + ".join(f"(v.{c} - b.{c}) * (v.{c} - b.{c})" for c in x)
    floor = lambda c: f"(sum(v.{c}) - ((sum(v.{c}) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT v.row, v.p, min(struct_pack(d := {apart}, k := b.k)) AS best FROM v JOIN b{r} b USING (p) GROUP BY v.row, v.p)")
        if r < rounds:
            means = ", ".join(f"CAST({floor(c)} AS BIGINT) AS {c}" for c in x)
            steps.append(f"m{r} AS (SELECT v.p, a.best.k AS k, {means} FROM v JOIN a{r} a USING (row, p) GROUP BY v.p, a.best.k)")
            steps.append(f"b{r + 1} AS (SELECT b.p, b.k, {', '.join(f'coalesce(m.{c}, b.{c}) AS {c}' for c in x)} FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.k = b.k)")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row, p, {", ".join(f"e[p * {width} + {k + 1}] AS {c}" for k, c in enumerate(x))} FROM kept, range({parts}) AS t(p)),
b0 AS (SELECT p, row AS k, {", ".join(x)} FROM v WHERE row < {entries}),
{", ".join(steps)},
coded AS (SELECT row, string_agg(format('{{:02x}}', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(concat_ws(',', {", ".join(x)}), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), books"""
