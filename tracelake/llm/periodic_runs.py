"""Periodic runs of words by bit-parallel lags.

The word numbers of several texts stand side by side as bit planes, one big
integer for each bit. For a lag q each plane is XORed with itself shifted by q
and the results are ORed: a 0 says that two words q apart are equal. ANDing the
inverse with itself, shifted by 1, 2, 4 and so on, leaves a 1 only where a
stretch of zeros is long enough; most lags end there, with two planes looked
at. What is left over is read off as runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C

#: A run has at least so many words, and two periods.
LEAST = 12
#: Words of the texts that stand side by side (a longer text stands alone), and bytes of text cut to words at once.
SIDE_BY_SIDE, BLOCK_BYTES = 1 << 14, 4 << 20
#: Planes and stretch that settle most lags.
FEW_PLANES, SHORT = 2, 16

Run = tuple[int, int, int]


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _stretches(ones: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of ones."""
    flags = np.unpackbits(np.frombuffer(ones.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    edges = np.diff(flags, prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _long_enough(ones: int, have: int, need: int) -> int:
    """Where need ones follow each other, given where have do."""
    while have < need and ones:
        step = min(have, need - have)
        ones &= ones >> step
        have += step
    return ones


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """Start, length and smallest period of every run of each text, by start, then period.

    Each text is followed by a place that equals no other. A stretch of q or more
    equal pairs (all that count) can't pass over it: the place would be
    one side of a pair in it.
    """
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    size = int(starts[-1])
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in (*t, b"")), np.int64, size)
    planes = [_bits((ids >> k) & 1) for k in range(max(1, (len(number) - 1).bit_length()))]
    between = np.zeros(size, bool)
    between[starts[1:] - 1] = True
    between, full = _bits(between), (1 << size) - 1
    found: list[list[Run]] = [[] for _ in texts]
    seen: set[tuple[int, int]] = set()
    for q in range(1, max(map(len, texts), default=0) // 2 + 1):
        need = max(least - q, q)
        few = FEW_PLANES if need >= SHORT else len(planes)
        differs = 0
        for plane in planes[:few]:
            differs |= plane ^ (plane >> q)
        equal = _long_enough(full ^ differs, 1, min(need, SHORT))
        if not equal:
            continue
        for plane in planes[few:]:
            differs |= plane ^ (plane >> q)
        equal = _long_enough(full ^ (differs | between | (between >> q)), 1, need)
        if not equal:
            continue
        for first, last in zip(*_stretches(equal, size), strict=True):
            begin, end = int(first), int(last) + need + q
            # A smaller period of the same stretch divides q, and its run has the same ends.
            if (begin, end) not in seen:
                seen.add((begin, end))
                text = int(np.searchsorted(starts, begin, "right")) - 1
                found[text].append((begin - int(starts[text]), end - begin, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by single spaces, without those behind the first period of a run."""
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        drop = np.cumsum(edges[:-1]) > 0
        words = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
    return b" ".join(words)


def _side_by_side(texts: list[list[bytes]], least: int) -> Iterator[list[int]]:
    """Groups of texts of similar length that may hold a run."""
    group, total, kind = [], 0, 0
    for k in sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: len(texts[k])):
        size = len(texts[k])
        if group and (total + size > SIDE_BY_SIDE or size.bit_length() != kind):
            yield group
            group, total = [], 0
        group.append(k)
        total, kind = total + size, size.bit_length()
    if group:
        yield group


def _finder(keep: list[str], least: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = C.rows_of(batch, "__tl_text")
            for lo, hi, data, offsets in C.slices(column, BLOCK_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                runs: list[list[Run]] = [[] for _ in texts]
                for group in _side_by_side(texts, least):
                    for k, found in zip(group, runs_of([texts[k] for k in group], least), strict=True):
                        runs[k] = found
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(found) for found in runs]), pa.int32()), values)
                kept = pa.array([_collapsed(t, found) for t, found in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), lists, kept], [*keep, "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text: Column, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The keep columns, runs and collapsed of every row of docs, from the whole text that the column expression gives.

    Words are maximal runs of anything but space and tab to carriage return. runs
    array<struct<start, length, period>> lists, by start, then period, the stretches of at least
    least words and two smallest periods that no neighbouring word extends.
    collapsed joins by single spaces the words that aren't behind the first
    period of a run. Null text counts as empty: no runs, collapsed is empty.
    Repeated rows are rows of their own; an empty table gives no rows; new columns
    take the place of kept ones called runs or collapsed.

    A text of n words takes n / 2 lags of n / 30 machine steps each, so a very
    long one takes a time that grows with the square of its words; it holds only its words and
    planes.
    """
    types = dict(docs.dtypes)
    keep = [c for c in keep if c not in ("runs", "collapsed")]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__tl_text")).mapInArrow(_finder(keep, least), schema)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, or for one id of ten its words with a periodic rest.

    h is the crc32 of the decimal id (null: of the empty string) and g = h / 10. Where 10 divides h, the words
    from a = g % n on repeat the p words that begin there, p = 1 + (n - a) / (3 + g % 8).
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), C.WORD_BREAK), lambda w: w != "")
    h = C.id_crc32(doc_id)

    def repeated(n: Column, w: Column) -> Column:
        g = F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))))

    # The words stand in a struct of one, so that each use of them reads what was split once.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(F.size(w), w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(made, F.lit(0))).otherwise(text)


def run_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of docs with planted runs.

    The four middle columns are the longest run's (ties: smallest start, then
    period), null without one.
    """
    found = find_runs(docs.select("doc_id", "text"), with_planted_runs(F.col("doc_id"), F.col("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    all_lines = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(all_lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words of a text by lag, their islands, and the stretches that these make.
RUNS_SQL = r"""
WITH h AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS plain,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, e: xor(d >> 1, 3988292384::BIGINT * (d & 1)))), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT *, len(plain) AS n, (h // 10) % greatest(len(plain), 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
w AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: plain[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE plain END AS words FROM p),
u AS (SELECT row, n, unnest(words) AS word, unnest(range(n)) AS i FROM w),
pairs AS (SELECT l.row, l.i, r.i - l.i AS q FROM u l JOIN u r ON l.row = r.row AND l.word = r.word AND r.i > l.i AND 2 * (r.i - l.i) <= l.n),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT u.row, string_agg(u.word, ' ' ORDER BY u.i) AS collapsed FROM u ANTI JOIN dropped d ON d.row = u.row AND d.i = u.i GROUP BY u.row),
best AS (
  SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
    min(struct_pack(l := -length, s := start, p := period)) AS b FROM runs GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, 1000 * -b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (row) LEFT JOIN kept USING (row)"""
