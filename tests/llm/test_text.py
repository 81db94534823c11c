"""Tokens, rules, mixing, shards, languages and toxicity against brute force or held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import common, compression_rules, importance, language_id, mixing, sentencepiece_codec, sharding, toxicity
from tracelake.llm.queries import model_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    rows = [(i, t, lang, src, len(t or "")) for i, t, lang, src in rows]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts(n=150):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", " ", "0", "!!", "<s>", "<0x0A>", ".", "\x00", "▁▁", "ñ", "Z"]
    out = [None, "", " ", "  ", "\n", " a", "a ", "▁", "▁ ▁a", "a\n\nb", "x" * 5000, " " * 40, "<unk></s>"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_encode_and_decode_as_the_library(spark):
    import sentencepiece

    path = model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = dict(enumerate(odd_texts()))
    docs = frame(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = {r.doc_id: r for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = library.encode(t or "")
        assert got[i].ids == want, (t, want)
        assert got[i].decoded == library.decode(want), t
    row = {r.doc_id: r for r in sentencepiece_codec.digests(sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path)).collect()}
    for i, t in texts.items():
        want = library.encode(t or "")
        assert row[i].n_tokens == len(want)
        assert row[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_decode_any_ids_as_the_library():
    import sentencepiece

    path = model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 400 if k % 2 else 32000, rng.integers(0, 12)) for k in range(400)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = sentencepiece_codec.decode_ids(path, np.concatenate(lists).astype(np.int64), offsets)
    assert got == [library.decode(x.tolist()) for x in lists]


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for starts in windows.values() if len(starts) > 1 for k in starts for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = odd_texts(60) + ["\n".join(rng.choice(["a b c", "  ", "x # y", "é|é", "one two three four five six seven eight nine"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in compression_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        want = brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_compression_bands_reject_junk_and_keep_prose(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("aeioustnrlh") for _ in range(rng.randrange(1, 9))) for _ in range(1500))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(60)) for _ in range(200))
    repeated = " ".join(f"{w} {w}x {w}y" for w in ["buy", "now"] * 8) * 200
    half = prose + " " + " ".join(rng.choice(["go", "on"]) for _ in range(12_000))
    rows = {r.doc_id: r for r in compression_rules.quality_rules(frame(spark, [(1, prose, "en", "s"), (2, noise, "en", "s"), (3, repeated, "en", "s"), (4, half, "en", "s")])).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[3].kept and not rows[4].kept


def test_ratios_chunks_and_verdict_by_brute_force(spark):
    import zstandard

    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = lambda n: " ".join("".join(rng.choice("aeioustnrlh") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    noise = lambda n: "".join(rng.choice(letters) if rng.random() < 0.95 else " " for _ in range(n))
    texts = [None, "", "a", *map(prose, (30, 300, 900, 2500, 6000)), prose(1600) + noise(4000), prose(1400) + " " + noise(3000), noise(9000), prose(200) * 9]
    limits = compression_rules.Limits(np.array([9.0, 12.0, 14.0]), np.array([1.5, 2.0, 2.1]), np.array([0.1, 0.05, 0.05]))
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))

    def inside(b):
        at = np.log2(len(b))
        beyond = max(0, 9 - at, at - 14)
        centre = np.interp(at, [9, 12, 14], [1.5, 2.0, 2.1])
        width = 4 * np.interp(at, [9, 12, 14], [0.1, 0.05, 0.05]) * (1 + 2 * beyond) + 0.3 * beyond
        return centre - width <= len(b) / size(b) <= centre + width

    for fitted in (limits, compression_rules.NO_LIMITS):
        rows = {r.doc_id: r for r in compression_rules.quality_rules(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), fitted).collect()}
        for i, t in enumerate(texts):
            b, r = (t or "").encode(), rows[i]
            assert r.ratio == (len(b) / size(b) if b else 0)
            if fitted is limits and b:
                chunks = [b[k : k + 4096] for k in range(0, len(b), 4096)]
                outside = 1 - np.mean([inside(c) for c in chunks]) if len(b) > 4096 else 0
                assert abs(r.chunks_outside - outside) < 1e-9 and r.inside == inside(b)
            assert r.kept == (not r.base_failed and r.inside and r.chunks_outside <= 0.25)


def test_quality_rules_on_labelled_documents(spark):
    docs, labels = common.documents(spark, SF), common.labels(spark, SF)
    limits = compression_rules.fit_limits(docs, labels.where("quality = 1"))
    rows = compression_rules.quality_rules(docs, limits).join(labels, "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.99
    assert rows[rows.quality == 0].kept.mean() < 0.5
    none = compression_rules.fit_limits(docs.where("false"), labels)
    assert not len(none.octaves)
    assert compression_rules.quality_rules(docs.where("false"), limits).count() == 0


def brute_mix(rows, quality):
    sizes = {}
    for i, t, _, s in rows:
        sizes.setdefault(s, []).append((i, len(WORD.findall(t or ""))))
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for _, n in sizes[s]) for s in names}
    target, rest, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * total[s]
            rest -= target[s]
        open_ -= full
    out = {}
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - epochs * total[s]

        def key(x):
            text = "" if x[0] is None else str(x[0])
            u = (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return -np.log(u) / {1: 1.0, 0: 0.25}.get(quality.get(x[0]), 0.75)

        before = 0
        for i, n in sorted(sizes[s], key=lambda x: (key(x), x[0] is None, x[0] or 0, x[1])):
            out.setdefault((i, n), []).append((total[s], target[s], n * (epochs + (before + n / 2 <= left and n > 0))))
            before += n
    return out


@pytest.mark.parametrize("weights_of", ["many", "one"])
def test_mix(spark, weights_of):
    rng = random.Random(6)
    sources = ["b", "a", "é", None, "hot", "hot", "hot"] if weights_of == "many" else ["x"]
    rows = [(k, " ".join("w" * rng.randrange(0, 2) or "v" for _ in range(rng.randrange(0, 40))), "en", rng.choice(sources)) for k in range(300)] + [(None, "no id", "en", "a"), (5, "again", "en", "b"), (900, None, "en", "c")]
    quality = {k: k % 2 for k in range(0, 200)}
    labels = spark.createDataFrame([(k, q) for k, q in quality.items()] + [(None, 1)], "doc_id long, quality int")
    plan = mixing.mix_plan(frame(spark, rows), labels).collect()
    want = brute_mix(rows, quality)
    got = {}
    for r in plan:
        got.setdefault((r.doc_id, r.size), []).append((r.source_size, pytest.approx(r.target), r.taken))
    assert {k: sorted(v, key=lambda x: x[2]) for k, v in want.items()} == {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()}
    copies = mixing.mix_rows(frame(spark, rows).withColumnRenamed("lang", "copies").withColumnRenamed("n_chars", "size"), labels)
    assert copies.columns == ["doc_id", "text", "copies", "source", "size"]
    assert copies.where("doc_id = 7").count() == next((r.copies for r in plan if r.doc_id == 7))


def test_shards(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["é", "xy", ""]) * rng.randrange(0, 50), "en", "s") for k in range(500)] + [(None, None, "en", "s"), (7, "seven", "en", "s")]
    got = sharding.assign_shards(frame(spark, rows)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t, _, _ in ordered]
    total, before, want, slots = sum(sizes), 0, [], {}
    for (i, t, _, _), n in zip(ordered, sizes, strict=True):
        shard = (2 * before + n) * 16 // (2 * total)
        want.append((i, n, zlib.crc32((t or "").encode()), "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += n
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert max(slots.values()) and len(slots) == 16


def brute_bits(texts, order=3):
    """Code length function of one language by plain dictionaries."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    counts = {}
    for t in texts:
        s = [32] * order + [fold(b) for b in t.encode()]
        for p in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[p - k : p]), {}).setdefault(s[p], 0)
                counts[tuple(s[p - k : p])][s[p]] += 1

    def bits(text):
        s = [32] * order + [fold(b) for b in text.encode()]
        total = 0.0
        for p in range(order, len(s)):
            for k in range(order, -1, -1):
                seen = counts.get(tuple(s[p - k : p]))
                if seen is None:
                    continue
                n = sum(seen.values())
                if s[p] in seen:
                    total -= np.log2(seen[s[p]] / (n + len(seen)))
                    break
                total -= np.log2(len(seen) / (n + len(seen)))
            else:
                total += 8
        return total

    return bits


def test_code_lengths_are_exact(spark):
    rng = random.Random(11)
    learn = {"aa": ["The cat sat. ", "that hat é!"], "bb": ["Der Hund und", "ßen über uns"]}
    docs = spark.createDataFrame([(lang, t) for lang, ts in learn.items() for t in ts], "lang string, text string")
    trees = language_id.fit_trees(docs)
    assert trees.langs == ["aa", "bb"]
    bits = [brute_bits(learn[lang]) for lang in trees.langs]
    for _ in range(40):
        text = "".join(rng.choice("thecat Dunßéx1.") for _ in range(rng.randrange(1, 30)))
        raw = np.frombuffer(text.encode(), np.uint8)
        grams, _ = language_id._grams(raw, np.array([0, len(raw)]))
        assert np.allclose(trees.cost(grams.astype(np.int64)).sum(0), [b(text) for b in bits], rtol=1e-5)


def test_code_lengths_count_every_gram(spark):
    rng = random.Random(12)
    learn = {"aa": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150_000)), "bb": "".join(rng.choice("etaoin shé") for _ in range(5000))}
    trees = language_id.fit_trees(spark.createDataFrame(list(learn.items()), "lang string, text string"))
    assert len(trees.levels[3][0]) > 100_000
    bits = [brute_bits([learn[lang]]) for lang in trees.langs]
    for _ in range(10):
        k = rng.randrange(140_000)
        text = learn["aa"][k : k + 50] + "éé zq"
        raw = np.frombuffer(text.encode(), np.uint8)
        assert np.allclose(language_id._bits(trees, raw, np.array([0, len(raw)]))[0], [b(text) for b in bits], rtol=1e-5)


def test_languages_of_held_out_documents(spark):
    rows = language_id.identify(common.documents(spark, SF)).join(common.documents(spark, SF).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 100 and (rows.lang_pred == rows.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_languages_of_odd_texts(spark):
    rows = [(1, None, "en", "s"), (2, "123 !!", "en", "s"), (3, "", None, "s"), (4, "the cat", None, "s"), (None, "the hat", "en", "s"), (6, "the mat", "en", "s"), (7, "日", "en", "s"), (8, "x" * 200_000, "en", "s")]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 7)] == ["und", "und", "und", "en", "en"]
    assert got[None].held_out and got[6].held_out == (zlib.crc32(b"6") % 5 == 0)
    alone = language_id.identify(frame(spark, [(1, "no language known", None, "s")])).collect()
    assert alone[0].lang_pred == "und" and alone[0].score == 0
    assert language_id.identify(frame(spark, [])).count() == 0


def test_importance_weights(spark):
    docs = common.documents(spark, SF)
    rows = importance.importance_sample(docs, common.labels(spark, SF).where("quality = 1"), keep=0.8).toPandas()
    assert len(rows) == 1000 and rows.kept.sum() == 800
    assert rows[rows.kept].gumbel_key.min() >= rows[~rows.kept].gumbel_key.max()
    judged = rows.merge(common.labels(spark, SF).toPandas(), on="doc_id")
    assert judged[judged.quality == 1].log_weight.median() > 0 > judged[judged.quality == 0].log_weight.median()
    assert importance.importance_sample(frame(spark, []), common.labels(spark, SF)).count() == 0
    odd = importance.importance_sample(frame(spark, [(1, None, "en", "s"), (None, "", "en", "s"), (1, None, "en", "s")]), common.labels(spark, SF), keep=0.5).collect()
    assert [r.log_weight for r in odd] == [0, 0, 0] and sum(r.kept for r in odd) == 2


def test_importance_ratio_by_counting(spark):
    texts = [(1, "good text here", "en", "s"), (2, "bad!! text###", "en", "s"), (3, None, "en", "s")]
    ratio = importance.fit_ratio(frame(spark, texts), spark.createDataFrame([(1,), (None,)], "doc_id long"))
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, t, _, _ in texts:
        b = np.frombuffer((t or "").encode(), np.uint8)
        grams, _ = importance._buckets(b, np.array([0, len(b)]))
        assert len(grams) == (5 if i == 1 else 7 if i == 2 else 0)
        for g in grams:
            raw[g] += 1
            target[g] += i == 1
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.fit_characters(common.documents(spark, SF))


@pytest.mark.parametrize(("said", "meant"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("st@t10n", "station"), ("w0rthl3ss", "worthless"), ("t-r-a-s-h", "trash"), ("clowwwwn", "clown"), ("p@thet!c", "pathetic"), ("t h e r e", "there")])
def test_disguises_are_read(characters, said, meant):
    assert toxicity.decode(said, characters) == meant


HIDDEN = [("hat3", "hate"), ("idio7", "idiot"), ("worthle$$", "worthless"), ("usele55", "useless"), ("1d107", "idiot"), ("$tup!d", "stupid"), ("i d 1 o t", "idiot"), ("t - r - a - s - h", "trash"), ("m 0 r o n", "moron"), ("iiddiioott", "idiot"), ("st" + "u" * 80 + "pid", "stupid"), ("i" + "." * 70 + "d.i.o.t", "idiot"), ("h@t€", "hate"), ("w0rthl€$$", "worthless")]


@pytest.mark.parametrize(("said", "meant"), HIDDEN)
def test_hidden_disguises_reach_the_channel(characters, said, meant):
    raw = np.frombuffer(f"table {said} garden".encode(), np.uint8)
    plain = np.frombuffer(f"table garden {meant}".encode(), np.uint8)
    features = [toxicity._restored(b, np.array([0, len(b)]), toxicity.Restorer(characters))[1] for b in (raw, plain)]
    a, b = (sorted(h for hashes, _ in f for h in hashes.tolist()) for f in features)
    assert a == b


def test_clean_words_stay(spark, characters):
    words = {w for r in common.documents(spark, SF).select("text").collect() for w in (r.text or "").lower().split()}
    doubled = sorted(w for w in words if re.fullmatch(r"[a-z]{4,}", w) and re.search(r"(.)\1", w) and not re.search(r"(.)\1\1", w))
    assert len(doubled) > 1000 and sum(toxicity.decode(w, characters) == w for w in doubled) > 0.99 * len(doubled)
    marked = sorted(w for w in words if re.fullmatch(r"[a-z]{4,}", w))[::50]
    assert sum(toxicity.decode(w + "!", characters) == toxicity.decode(w, characters) for w in marked) > 0.99 * len(marked)


def test_disguised_words_are_found():
    text = b"plain words, e.g. ends### i d i o t and m0ron sooo \xc3\xa9\xc3\xa9\xc3\xa9 x"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, doc = common.words(buf, np.array([0, len(buf)]))
    odd, runs = toxicity.disguised(buf, starts, ends, doc)
    assert [text[starts[k] : ends[k]] for k in odd] == [b"e.g.", b"m0ron", b"sooo"]
    assert [text[starts[a] : ends[b - 1]] for a, b in runs] == [b"i d i o t"]


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.toxicity(common.documents(spark, sf), common.labels(spark, sf)).join(common.labels(spark, sf), "doc_id").where("held_out").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.8
    assert (good.predicted == 0).mean() > 0.98


def test_toxicity_of_disguised_words(spark):
    rng = random.Random(3)
    plain = "table chair window river mountain paper garden yellow".split()
    rows, labels = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if k % 4 == 0:
            w[rng.randrange(30)] = "moron"
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(k % 4 == 0)))
    rows += [(1000, "table chair m0r0n window", "en", "s"), (1001, "table m o r o n window", "en", "s"), (1002, "table chair window", "en", "s"), (1003, None, "en", "s"), (1004, "", "en", "s"), (None, "a m0r0n", "en", "s")]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")).collect()}
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 0, 0, 0, 1]
    kept = toxicity.keep_rows(frame(spark, rows).withColumnRenamed("lang", "score"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"]
    assert {r.doc_id for r in kept.where("doc_id >= 1000").collect()} == {1002, 1003, 1004}


@pytest.mark.parametrize("every", [2, 3, 10])
def test_texts_without_features_stay_whatever_the_labels(spark, every):
    rng = random.Random(every)
    plain = "table chair window river mountain paper garden yellow".split()
    rows = [(k, " ".join([rng.choice(plain) for _ in range(20)] + (["moron"] if k % every == 0 else [])), "en", "s") for k in range(400)]
    blank = [None, "", " \n", "42 17", "?!... 7", "日本 語", "qzxv wvzq"]
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(blank)] + [(2000, "table chair moron", "en", "s"), (2001, "river table", "en", "s")]
    labels = spark.createDataFrame([(k, int(k % every == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert all(got[1000 + i].predicted == 0 and 0 < got[1000 + i].score < 0.05 for i in range(len(blank)))
    assert got[2000].predicted == 1 and got[2001].predicted == 0
    kept = {r.doc_id for r in toxicity.keep_rows(frame(spark, rows), labels).collect()}
    assert kept >= {1000 + i for i in range(len(blank))} and 2000 not in kept and 2001 in kept


def test_kept_columns_give_way_to_new_ones(spark):
    docs = frame(spark, [(1, "a b", "en", "s")]).withColumn("ids", F.lit("x")).withColumn("odd name", F.lit(5))
    got = sentencepiece_codec.encode(docs, model_path(), keep=("doc_id", "ids", "odd name", "text"))
    assert got.columns == ["doc_id", "odd name", "text", "ids"] and got.first().text == "a b" and len(got.first().ids) == 2


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(frame(spark, [(1, "x", "en", "s")]), none).collect()} == {0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_long_texts_are_scored_whole(spark, characters):
    text = b"table chair m0r0n river d o o r garden " * 80_000
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": [text.decode()]})
    (got,) = toxicity._texts(batch, toxicity.Restorer(characters))
    assert got[2][0] == 80_000 * 9
    short = __import__("pyarrow").RecordBatch.from_pydict({"text": [text[:39].decode()]})
    (one,) = toxicity._texts(short, toxicity.Restorer(characters))
    long_counts, short_counts = ({h: int(n) for h, n in zip(*np.unique(np.concatenate([h for h, _ in r[3]]), return_counts=True), strict=True)} for r in (got, one))
    assert long_counts == {h: 80_000 * n for h, n in short_counts.items()}


def test_long_texts_have_the_sum_of_their_bits(spark):
    docs = spark.createDataFrame([("aa", "The cat sat. "), ("bb", "Der Hund und")], "lang string, text string")
    trees = language_id.fit_trees(docs)
    raw = np.frombuffer(b"the cat und der hund " * 50, np.uint8)
    whole = language_id._bits(trees, raw, np.array([0, len(raw)]))
    assert np.allclose(whole, language_id._bits(trees, raw, np.array([0, len(raw)]), piece=100))
    both = np.concatenate([raw, raw])
    assert np.allclose(language_id._bits(trees, both, np.array([0, len(raw), 2 * len(raw)])), np.concatenate([whole, whole]))


def brute_weight(text, ratio):
    """Log weight by splitting in Python: runs of letters and digits or of punctuation, and pairs of neighbours."""
    kinds = {c: 0 for c in b" \t\n\v\f\r"} | {c: 1 for c in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]}
    tokens, last = [], None
    for c in (text or "").encode():
        kind = kinds.get(c, 2)
        if kind:
            if kind == last:
                tokens[-1].append(c)
            else:
                tokens.append([c])
        last = kind
    hashes = []
    for t in tokens:
        b = np.array(t, np.uint8)
        hashes.append(int(common.hash_ranges(b, np.array([0]), np.array([len(b)]), common.BYTE_CODE_LOWER)[0]))
    pairs = [int(common.mix(np.array([(a * int(common.STEPS[0]) + b * int(common.STEPS[1])) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:], strict=False)]
    return sum(ratio[h >> 50] for h in hashes + pairs)


def test_importance_selection_by_brute_force(spark):
    rng = random.Random(21)
    pool = ["good", "fine", "words", "spam!!", "###", "buy", "now", "é", "a1"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))), "en", "s") for i in range(60)] + [(None, "good fine", "en", "s"), (61, None, "en", "s")]
    docs, target = frame(spark, rows), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    ratio = importance.fit_ratio(docs, target)
    got = {(r.doc_id): r for r in importance.importance_sample(docs, target, keep=0.4).collect()}
    keys = {}
    for i, t, _, _ in rows:
        uniform = (int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keys[i] = brute_weight(t, ratio) - np.log(-np.log(uniform))
        assert abs(got[i].log_weight - brute_weight(t, ratio)) < 1e-6 and abs(got[i].gumbel_key - keys[i]) < 1e-6
    best = sorted(keys, key=lambda i: (-keys[i], i is None, i))[: round(0.4 * len(rows))]
    assert {i for i, r in got.items() if r.kept} == set(best)


def test_decoding_by_trying_all_readings(characters):
    import itertools

    rng = random.Random(8)
    costs = characters
    number = toxicity._number
    for _ in range(60):
        word = "".join(rng.choice("ab10$@!.-ss") for _ in range(rng.randrange(2, 6)))

        def price(readings):
            x = y = 0
            total = sum(p for _, p in readings)
            for c in "".join(r for r, _ in readings):
                z = number(c)
                if z or y:
                    total += costs[x, y, z]
                    x, y = y, z
            return total + (costs[x, y, 0] if y else 0)

        every = [(price(r), "".join(c for c, _ in r).strip()) for r in itertools.product(*toxicity.lattice(word))]
        best = min(every)[0]
        assert any(abs(cost - best) < 1e-9 and said == toxicity.decode(word, costs) for cost, said in every)


def test_scores_by_brute_force(spark, characters):
    words = ["idiot", "hello", "there", "1d10t", "worthle$$", "fine", "morons", "$tation", "ok"]
    rng = random.Random(13)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 15))) for _ in range(40)] + ["", "t r a s h here"]
    one = lambda w: int(common.hash_ranges(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), common.BYTE_CODE_LOWER)[0])

    def features(text):
        said = re.sub(r"\bt r a s h\b", "trash", text).split()
        said = [toxicity.decode(w, characters) if re.search(r"[0-9$]", w) else w for w in said]
        out = []
        for w in " ".join(said).split():
            out.append(one(w))
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    out.append(int(common.mix(np.array([(one(w[:k]) + int(common.STEPS[40 + k])) % 2**64], np.uint64))[0]))
        return out

    every = sorted({f for t in texts for f in features(t)})
    scorer = toxicity.Scorer(np.array(every, np.uint64), characters)
    scorer.weights = np.array([rng.uniform(-1, 1) for _ in range(2 * len(every))])
    scorer.bias = -0.3
    got = {r.doc_id: r.score for r in toxicity.score_texts(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), scorer).collect()}
    for i, t in enumerate(texts):
        count = {}
        for f in features(t):
            count[f] = count.get(f, 0) + 1
        n = max(len(t.split()), 10)
        total = scorer.bias + sum(scorer.weights[every.index(f)] + scorer.weights[every.index(f) + len(every)] * np.log1p(100 * c / n) for f, c in count.items())
        assert abs(got[i] - (1 / (1 + np.exp(-total)) if count else toxicity.CLEAN)) < 1e-9, t


def test_doubled_letters_are_priced_before_they_are_decoded(characters):
    rng = random.Random(31)
    words = ["".join(rng.choice("aeilnorst") * rng.choice([1, 1, 1, 1, 2]) for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = " ".join(words).encode()
    buf = np.frombuffer(text, np.uint8)
    starts, ends, doc = common.words(buf, np.array([0, len(buf)]))
    every, _ = toxicity.disguised(buf, starts, ends, doc)
    some, _ = toxicity.disguised(buf, starts, ends, doc, characters)
    for k in set(every.tolist()) - set(some.tolist()):
        word = text[starts[k] : ends[k]].decode()
        assert toxicity.decode(word, characters) == word


def test_empty_tables_clashing_names_and_long_texts(spark):
    none = frame(spark, [])
    path = model_path()
    assert sentencepiece_codec.digests(sentencepiece_codec.decode(sentencepiece_codec.encode(none, path), path)).count() == 0
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_rows(none).count() == 0
    assert sharding.assign_shards(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(400_000))
    names = ["size", "score", "key", "before", "position", "kept", "ids", "component_id", "digest"]
    docs = frame(spark, [(1, long, "en", "a"), (2, "short text", "en", "b"), (3, None, None, None)])
    for n in names:
        docs = docs.withColumn(n, docs.source)
    assert {r.doc_id: r.size for r in mixing.mix_plan(docs).collect()} == {1: 400_000, 2: 2, 3: 0}
    assert {r.doc_id: r.size for r in sharding.assign_shards(docs).collect()} == {1: len(long) + 1, 2: 11, 3: 1}
    assert set(mixing.mix_rows(docs).columns) == set(docs.columns)
    rows = {r.doc_id: r for r in compression_rules.quality_rules(docs).collect()}
    assert rows[1].n_words == 400_000 and rows[3].n_words == 0
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {r.doc_id: list(r.ids) for r in sentencepiece_codec.encode(docs, path).collect()}
    assert ids[1] == library.encode(long) and ids[3] == []
    weights = {r.doc_id: r.n_grams for r in importance.importance_sample(docs, docs.select("doc_id")).collect()}
    assert weights[1] == 2 * 400_000 - 1 and weights[3] == 0


def test_limits_learn_from_every_good_text(spark, monkeypatch):
    docs = spark.range(22_000).selectExpr("id AS doc_id", "repeat(char(97 + id % 26), 64) AS text")
    read, ratio = spark.sparkContext.accumulator(0), compression_rules._ratio

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield from ratio(iter([batch]))

    monkeypatch.setattr(compression_rules, "_ratio", counted)
    limits = compression_rules.fit_limits(docs, docs.select("doc_id"))
    assert read.value == 22_000 and list(limits.octaves) == [6.0]


def test_fitting_limits_shuffles_no_texts(spark, monkeypatch):
    plans, write = [], common.materialize

    def planned(df):
        plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return write(df)

    monkeypatch.setattr(common, "materialize", planned)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(char(97 + id % 26), 64) AS text")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert list(compression_rules.fit_limits(docs, docs.where("doc_id < 200").select("doc_id")).octaves) == [6.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plans[0])
    assert moved and not any("text#" in columns for columns in moved)
