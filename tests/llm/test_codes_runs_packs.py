"""Vector codes, periodic runs and packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import packing, periodic_runs, vector_codes

# -- vector codes -------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) in order of id, all of one length that parts divides."""
    ints = [[int(np.floor(256 * np.float64(x))) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : p * width + width]) for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def owner(p, x):
        best = min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
        return best[1], best[0]

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[owner(p, v[p])[0]].append(v[p])
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    codes = [[owner(p, v[p]) for p in range(parts)] for v in cut]
    text = ",".join(str(c) for p in range(parts) for e in books[p] for c in e)
    return ["".join(f"{k:02x}" for k, _ in c) for c in codes], [sum(e for _, e in c) for c in codes], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("n", "spread", "length"), [(400, 0.1, 64), (150, 0.01, 32), (20, 1.0, 16), (300, 40.0, 48)])
def test_codes_by_brute_force(spark, n, spread, length):
    """Close vectors give ties and equal entries; few rows a small book; many blocks the same sums."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, length)], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows[5] = (5, rows[4][1], 1)
    code, error, digest = brute_codes(rows)
    sums = Counter()
    for (_, _, label), e in zip(rows, error):
        sums[label] += e
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = vector_codes.code_table(df).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {i: (code[i], error[i], sums[label], digest) for i, _, label in rows}


def test_filtering_owns_every_point_as_a_search_does():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 500, 3000):
        points = rng.integers(-5, 6, (n, 4)) if n % 2 else rng.integers(-90, 90, (n, 4))
        book = rng.integers(-9, 10, (64, 4))
        order, tree = vector_codes.grow(points)
        want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (vector_codes.owners(tree, book) == want[order]).all()
        count, sums = vector_codes.totals(tree, book)
        assert (count == np.bincount(want, minlength=64)).all()
        assert (sums[want[0]] == points[want == want[0]].sum(0)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 32, None), (3, [0.5] * 32, None), (None, [0.25] * 32, 1), (1, None, 1), (2, [nan] * 32, 1), (4, [inf] + [0.0] * 31, 1), (5, [None] + [0.0] * 31, 1), (6, [1e30, -1e30] + [0.0] * 30, 2), (7, [0.1] * 5, 2), (8, [], 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, error string")
    got = vector_codes.code_table(df).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.vec_id) == [(False, 3), (False, 3), (False, 6), (False, 7), (False, 8)] and sum(r.vec_id is None for r in got) == 1
    by = {r.vec_id: r for r in got}
    assert by[7].code is None and by[7].error is None and by[8].code is None and len(by[6].code) == 32 and by[3].label_error == 0
    assert vector_codes.code_table(df.limit(0)).collect() == []
    short = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.5], 0)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.code[:6] for r in vector_codes.code_table(short).collect()} == {1: "000000", 2: "000100"}


# -- periodic runs ------------------------------------------------------------------------------


def brute_runs(words, least=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def _periodic_texts():
    rng = random.Random(8)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, ["a", "b"] * 7 + ["a"], (["x"] * 6 + ["y"]) * 4]
    for _ in range(120):
        base = [rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 25))]
        out.append([rng.choice("abc") for _ in range(rng.randrange(9))] + base * rng.randrange(1, 7) + base[: rng.randrange(len(base) + 1)] + [rng.choice("xyz") for _ in range(rng.randrange(9))])
    out += [[rng.choice("ab") for _ in range(rng.randrange(300))] for _ in range(40)]
    return out


def test_runs_by_brute_force():
    texts = [[w.encode() for w in t] for t in _periodic_texts()]
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]
    for t in texts:
        assert periodic_runs.runs_of([t]) == [brute_runs(t)]


def test_run_table_by_brute_force(spark):
    rows = [(i, "  ".join(t) + " \n") for i, t in enumerate(_periodic_texts())] + [(900, None), (901, ""), (902, "\t"), (None, "a b " * 30), (903, "é \x1c b " * 20), (904, "w " * 30000), (3, "again " * 3), (3, "again " * 3)]
    df = spark.createDataFrame([(i, t, [1], "r", 5) for i, t in rows], "doc_id long, text string, runs array<int>, collapsed string, h int").repartition(3)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode() if i is not None else b"")
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words) if n < 5000 else [(0, n, 1)]
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        want.append((i, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    got = [tuple(r) for r in periodic_runs.run_table(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.run_table(df.limit(0)).collect() == []
    assert periodic_runs.find_runs(df, F.col("text"), keep=("doc_id", "runs", "h")).columns == ["doc_id", "h", "runs", "collapsed"]


# -- packing ------------------------------------------------------------------------------------


def byte_model():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check_packs(rows, texts, window):
    """Every id of every text once, gapless sequences of at most window ids; the number of sequences."""
    library = packing._library(byte_model())
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for t in texts]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == list(range(len(texts)))
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i]), (i, texts[i])
            assert r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes()), (i, texts[i])
            at += r.length
        assert at == len(want[i])
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_packs_hold_every_id_once(spark):
    rng = random.Random(4)
    words = ["the", "it's", "don't", "Zwölf", "naïve", "3½", "x²", "'s", "''ll", "<|endoftext|>", "日本", "😀", " ", "\u0085", "\x1c", " ", "…", "”", "  ", "\n\n", "\t", "×÷", "µm", "ªº", "-->", "a1b2", "́", "€5", "Ελ"]
    texts = [None, "", " ", "a" * 9000, "word " * 3000, "'s", " 's"] + [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, ids string, __tl_x int").repartition(4)
    for window, step, cut in ((2048, 8, 64), (256, 8, 16)):
        rows = packing.pack(df, byte_model(), window=window, step=step, least_cut=cut, with_ids=True).collect()
        total = sum(r.length for r in rows)
        assert check_packs(rows, texts, window) <= 1.03 * total / window + 2
        assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0), byte_model()).collect() == []


def test_packs_fill_windows_of_awkward_lengths(spark):
    """Texts of a bit more than half a window, which no two of fit: the gaps are cut to."""
    texts = ["a " * 150] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(df, byte_model(), window=256, step=8, least_cut=16).collect()
    assert check_packs(rows, texts, 256) <= 1.1 * sum(r.length for r in rows) / 256 + 1


def test_chunks_are_the_librarys():
    library = packing._library(byte_model())
    marks = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€", "�"]
    texts = [a.join(["", "b", "7", " ", "'", ""]) + " " + a + a for a in marks]
    rng = random.Random(2)
    texts += ["".join(rng.choice(marks) for _ in range(60)) for _ in range(300)]
    table = packing.IdTable(byte_model())
    offsets, ids = table.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_repeat_counts_are_least_squares():
    """No way that is used could do better, and no other way would."""
    rng = np.random.default_rng(5)
    ways = packing.combinations(32)
    assert (ways.sum(1) == 32).all() and len({tuple(w) for w in ways}) == len(ways) == 1 + 16 + sum(1 for a in range(1, 11) for b in range(a, 17) if b <= 32 - a - b)
    for histogram in (rng.integers(0, 50, 33), rng.poisson(300 * np.exp(-np.arange(33) / 6.0)), np.zeros(33)):
        histogram = histogram.astype(float)
        histogram[0] = 0
        weight = np.arange(33.0)
        x = packing.repeats(ways, histogram, weight)
        assert (x >= 0).all()
        counts = np.stack([np.bincount(w, minlength=33) for w in ways]).astype(float)
        counts[:, 0] = 0
        slope = (counts * weight) @ (weight * (histogram - x @ counts))
        scale = 1e-5 * max(1.0, (weight * histogram).max() * weight.max())
        assert slope.max() <= scale and np.abs(slope[x > 0]).max(initial=0) <= scale


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(6)
    for histogram in (rng.integers(0, 30, 257), rng.poisson(1e5 * np.exp(-np.arange(257) / 40)), np.eye(257, dtype=np.int64)[140] * 999, np.zeros(257, np.int64)):
        histogram = histogram.astype(np.int64)
        histogram[0] = 0
        plan = packing.make_plan(histogram)
        whole = Counter()
        for cut, size, low, high, begin, end, _, _ in plan.rows.tolist():
            whole[size] += (high - low) * ((end or 8 * size) - begin)
        assert whole == {s: 8 * s * n for s, n in enumerate(histogram.tolist()) if n}
        assert len(plan.rows) <= 40 * 257
        used = (plan.rows[:, 6] + plan.rows[:, 3] - plan.rows[:, 2]).max(initial=0)
        assert used <= 1.005 * (histogram * np.arange(257)).sum() / 256 + 3
