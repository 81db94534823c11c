"""Exact and near dedup against brute force."""

import hashlib
import os
import random
import string

import pytest

from tracelake.llm import exact_dedup, near_dedup, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


HARD = [(1, None), (2, ""), (3, "Same"), (4, "sAME"), (5, "É"), (6, "é"), (7, "same"), (7, "same"), (None, "other"), (None, "x"), (9, "X"), (10, "  "), (11, "a b c"), (12, "A  b\tc")]


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_groups(spark, counters):
    rng = random.Random(1)
    texts = HARD + [(100 + k, rng.choice(["hot", "Hot", "HOT", f"t{rng.randrange(40)}"])) for k in range(300)]
    got = {(r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, texts), counters=counters).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = set()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want |= {(i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), i == keep) for i in ids}
    assert got == want


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_rows_leave_one_of_each_text(spark, counters):
    texts = HARD + [(200 + k, "hot") for k in range(50)]
    docs = frame(spark, texts).withColumnRenamed("lang", "digest").withColumnRenamed("n_chars", "keep_id")
    left = exact_dedup.keep_rows(docs, counters=counters)
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted((r.text or "").translate(LOWER) for r in kept) == sorted({(t or "").translate(LOWER) for _, t in texts})
    assert {r.doc_id for r in kept if (r.text or "").translate(LOWER) == "hot"} == {249}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.keep_rows(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.keep_rows(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0


def shingles(text, width):
    w = (text or "").translate(LOWER).replace("\x1f", "\x1f")
    parts = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not parts:
        return frozenset()
    if len(parts) < width:
        return frozenset([tuple(parts)])
    return frozenset(tuple(parts[k : k + width]) for k in range(len(parts) - width + 1))


def brute_components(texts, width, percent):
    sets = [(i, shingles(t, width)) for i, t in texts]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return {(i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(sets)}


def near_texts(seed, n):
    """Families of copies with a few words changed, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    texts, k = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one two three four")], 10
    for _ in range(n):
        base = words(rng, rng.choice([3, 8, 30, 120]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            new = [rng.choice([w, w, w, f"new{rng.randrange(999)}"]) if rng.random() < rng.choice([0.0, 0.05, 0.1]) else w for w in base]
            texts.append((k, rng.choice([" ", "  ", "\n"]).join(new)))
            k += 1
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("width", "block"), [(4, 4096), (5, 7)])
def test_near_groups(spark, width, block):
    texts = near_texts(width, 25)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, texts), width=width, block=block).collect()}
    assert got == brute_components(texts, width, 80)


def test_near_rows_keep_one_of_each_group(spark):
    texts = near_texts(9, 10) + [(2, "one two"), (None, "one two"), (None, "alone here with no id at all")]
    left = near_dedup.keep_rows(frame(spark, texts))
    known = [(i, t) for i, t in texts if i is not None]
    want = {i for i, _, _, kept in brute_components(known, 5, 80) if kept}
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert [r.text for r in left.where("doc_id IS NULL").collect()] == ["alone here with no id at all"]
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rows_without_an_id_and_repeated_ids(spark):
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(6)]
    near = lambda k: " ".join(base[k][:-1] + [f"x{rng.random()}"])
    texts = [(None, near(0)), (None, near(0)), (None, near(1)), (7, near(1)), (3, near(2)), (3, near(3)), (9, near(3)), (None, " ".join(base[4])), (None, " ".join(base[4]).upper()), (4, "   "), (None, ""), (None, " ")]
    rows = near_dedup.near_groups(frame(spark, texts), width=5, percent=80).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r.component_id)
    assert found[7] == [7] and found[3] == [3, 3] and found[9] == [3] and found[4] == [4]
    assert sorted(found[None], key=lambda x: (x is None, x)) == [7] + [None] * 6
    left = near_dedup.keep_rows(frame(spark, texts)).collect()
    # One of each: the two without an id, 7, 3 (with 9), the copies in two cases, 4, and the row without text or id.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, 3), (False, 4), (False, 7)] + [(True, 0)] * 3


def brute_cover(texts, length):
    seen = {}
    raw = [(t or "").encode() for _, t in texts]
    for k, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((k, p))
    cover = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                cover[k][p : p + length] = b"\x01" * length
    return raw, cover


def brute_passages(raw, cover):
    runs = "".join(chr(x) for x in cover).split("\x00")
    at, found = 0, 0
    for run in runs:
        piece = raw[at : at + len(run)]
        found += len([w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", piece) if w]) >= 50
        at += len(run) + 1
    return found


def brute_repeats(texts):
    out = set()
    raw, cover = brute_cover(texts, 400)
    _, short = brute_cover(texts, 300)
    for (i, _), b, c, p in zip(texts, raw, cover, short, strict=True):
        spans = sum(1 for p in range(len(c)) if c[p] and (p == 0 or not c[p - 1]))
        out.add((i, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, gone in zip(b, c, strict=True) if not gone)).hexdigest(), brute_passages(b, p)))
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    passage = [" ".join(words(rng, n)) for n in (60, 100, 130, 200, 400)]
    texts = [(1, None), (2, ""), (3, "short"), (4, "é" * 700), (5, "ab" * 900), (6, passage[4]), (7, passage[4]), (8, "line of text\n" * 90)]
    for k in range(10, 60):
        parts = []
        for _ in range(rng.choice([1, 2, 3])):
            parts.append(" ".join(words(rng, rng.randrange(5, 80))))
            p = rng.choice(passage)
            a = rng.randrange(0, len(p) // 2)
            parts.append(p[a : a + rng.randrange(300, 1200)])
        texts.append((k, "".join(parts)))
    return texts


@pytest.mark.parametrize(("seed", "group"), [(1, 65_536), (2, 3)])
def test_repeats(spark, seed, group):
    texts = repeat_texts(seed)
    got = {tuple(r) for r in repeats.digest(repeats.remove_repeats(frame(spark, texts), group=group)).collect()}
    assert got == brute_repeats(texts)


@pytest.mark.parametrize(("seed", "group"), [(5, 65_536), (6, 3)])
def test_repeat_groups_hold_all_occurrences(spark, seed, group):
    rng, texts = random.Random(seed), repeat_texts(seed)
    raw, cover = brute_cover(texts, 300)
    at = {i: k for k, (i, _) in enumerate(texts)}
    groups = {}
    for r in repeats.repeat_groups(frame(spark, texts), group=group).collect():
        groups.setdefault((r.group_id, r.length), set()).add((at[r.doc_id], r.begin))
    covered = [bytearray(len(b)) for b in raw]
    looked = set(rng.sample(sorted(groups), min(60, len(groups))))
    for (name, length), places in groups.items():
        pieces = {raw[k][p : p + length] for k, p in places}
        assert len(pieces) == 1 and len(places) > 1 and length >= 300 and len(next(iter(pieces))) == length
        piece = pieces.pop()
        if (name, length) in looked:
            # Every occurrence in the table.
            found = {(k, p) for k, b in enumerate(raw) for p in range(len(b) - length + 1) if b.startswith(piece, p)}
            assert found == places
        for k, p in places:
            covered[k][p : p + length] = b"\x01" * length
    assert covered == cover


@pytest.mark.parametrize("group", [65_536, 2])
def test_a_long_repeat_is_one_group(spark, group):
    rng = random.Random(9)
    alone = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    long, longer, once = alone(1500), alone(6000), alone(900)
    texts = [(1, alone(50) + "X" + long + "P" + alone(400)), (2, "Y" + long + "Q"), (3, "R" + longer + "T" + longer + "S" + alone(10)), (4, longer), (5, once), (None, alone(30) + "Z" + long), (6, None)]
    groups = {}
    for r in repeats.repeat_groups(frame(spark, texts), group=group).collect():
        groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.begin))
    assert sorted((n, sorted(p, key=str)) for (_, n), p in groups.items()) == [(1500, [(1, 51), (2, 1), (None, 31)]), (6000, [(3, 1), (3, 6002), (4, 0)])]


def test_classes_of_the_interval_tree_are_the_maximal_repeats():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randrange(2, 12)
        lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 6))) for _ in range(n)]
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 6))) for _ in range(n)]
        got = {(frozenset(m.tolist()), a, b) for m, a, b in repeats.maximal_repeats(lefts, rights, __import__("numpy").zeros(n, int), need=3, walk=repeats._classes)}
        want = set()
        for i in range(n):
            for j in range(i):
                a, b = repeats._agree(lefts[i], lefts[j]), repeats._agree(rights[i], rights[j])
                if a + b >= 3:
                    members = frozenset(k for k in range(n) if lefts[k][:a] == lefts[i][:a] and len(lefts[k]) >= a and rights[k][:b] == rights[i][:b] and len(rights[k]) >= b)
                    want.add((members, a, b))
        # Pairs name every class: a class's members share exactly what some two of them share on each side.
        shared = lambda m: (len(os.path.commonprefix([lefts[k] for k in m])), len(os.path.commonprefix([rights[k] for k in m])))
        assert got == {(m, *shared(m)) for m, _, _ in want}


def test_repeated_rows_lose_long_texts(spark):
    text = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(200))
    got = repeats.digest(repeats.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, "x")]))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, len(text)), (1, len(text)), (1, len(text)), (2, 0)]


def test_prefix_intervals_are_those_of_a_tree():
    rng = random.Random(3)
    for _ in range(50):
        texts = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(12))
        common = [0] + [repeats._agree(a.encode(), b.encode()) for a, b in zip(texts, texts[1:], strict=False)]
        got = set(repeats.prefix_intervals(common))
        want = set()
        for a in range(12):
            for b in range(a + 1, 12):
                least = min(common[a + 1 : b + 1])
                if (a == 0 or common[a] < least) and (b == 11 or common[b + 1] < least):
                    want.add((least, a, b))
        assert {g for g in got if g[2] > g[1]} == want


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(1, 150)] + [(5000 + k, 4999 + k) for k in range(1, 300)]
    crossed = [(200 + (k * 37) % 41, 200 + ((k + 1) * 37) % 41) for k in range(40)]
    star = [(300, 300 + k) for k in range(1, 20)]
    loose = [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(45)]
    edges = chain + crossed + star + loose
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in parent if x not in alone}
    assert near_dedup.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces_of_long_texts_give_what_the_whole_gives():
    import numpy as np

    from tracelake.llm import common

    rng = np.random.default_rng(5)
    buf = rng.choice(np.frombuffer(b"abcdef  \n", np.uint8), 30_000)
    buf[5000:9000] = buf[20_000:24_000]
    offsets = np.array([0, 700, 700, 12_000, 30_000])
    assert np.array_equal(repeats.anchors(buf, offsets, 1000), repeats._anchors(buf, offsets))
    starts, ends, _ = common.words(buf, offsets)
    whole = common.range_hash(common.prefix_hash(buf), starts, ends)
    assert np.array_equal(common.hash_ranges(buf, starts, ends, piece=64), whole)


def test_spans_of_nested_repeats_hold_only_the_widest():
    import numpy as np
    import pyarrow as pa

    # 400 suffixes that share more and more on both sides: their interval tree names most of them again and again.
    n = 400
    right = [b"r" * (300 if k == n else k % 300) + bytes([65 + k % 26]) * 5 for k in range(n)]
    left = [b"l" * ((k * 7) % 300) + bytes([97 + k % 26]) * 5 for k in range(n)]
    rows = pa.RecordBatch.from_pylist(
        [{"anchor": 1, "around": k, "doc_id": k, "text_key": k, "pos": 300, "alone": True, "lefts": a, "rights": b} for k, (a, b) in enumerate(zip(left, right, strict=True))], schema=repeats._CONTEXT_SCHEMA
    )
    got = {}
    for r in repeats._spans(rows).to_pylist():
        got.setdefault(r["doc_id"], []).append((r["begin"], r["end"]))
    want = {}
    for members, lefts, end in repeats.maximal_repeats(left, right, np.ones(n, np.int64)):
        for m, reach in zip(members.tolist(), lefts.tolist(), strict=True):
            want.setdefault(m, set()).add((300 - reach, 300 + repeats.ANCHOR + end))
    for m, spans in want.items():
        assert sorted(got[m]) == sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))
    assert set(got) == set(want) and sum(map(len, got.values())) < sum(map(len, want.values()))
