"""Toxicity of deobfuscated text: a noisy channel, then a linear score.

Words that look disguised (letters swapped for digits or signs, letters spaced
out, letters drawn out) become lattices of what may have been meant; Viterbi
decoding under a character language model, counted over the whole corpus, picks
the reading. The restored text's words and word beginnings are then scored by a
logistic model fitted on labelled rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import common as C

#: Most labelled rows that the score is fitted on (those with the smallest id hashes), and features that it has.
FIT_ROWS, FEATURES = 12_000, 2048
#: A feature needs so many labelled texts.
LEAST_TEXTS = 2
THRESHOLD = 0.3
#: The score of a text in which no feature is found.
CLEAN = 0.005
#: The largest share of toxic texts that the fit starts from.
MOST_TOXIC = 0.2
PREFIXES = (4, 5, 6, 7, 8)
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e"}
#: What may stand between spaced-out letters.
GAPS = " .-_*~"
#: Costs in nats: a sign read as a letter, a gap dropped, a drawn-out letter cut, a sign read as the end of a word.
SWAP, DROP, CUT, BREAK = 0.7, 0.3, 0.5, 6.0
#: A doubled letter read as one (most are meant; where most letters of a word are doubled it costs CUT), an exclamation mark at the end read as one.
HALVE, TAIL = 7.0, 2.0
#: Longer words are read each time anew instead of being remembered.
REMEMBERED = 64
#: Bytes of a long text that are looked at together; it is parted after a blank.
PIECE = 1 << 20
_SIZE = 28  # 0: boundary, 1-26: letters, 27: any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_LETTER = _CLASS > 0
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128] + [ord(c) for c in GAPS.strip()]] = True
#: Gaps that can't be letters.
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[ord(c) for c in GAPS if c not in LEET]] = True


# -- character language model -------------------------------------------------------------------


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for _, _, buf, _ in C.slices(C.rows_of(batch, "text")):
            text = np.concatenate([[32, 32], buf, [32, 32]]).astype(np.uint8)
            for k in range(0, len(text) - 2, PIECE):
                c = _CLASS[text[k : k + PIECE + 2]]
                total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def fit_characters(docs: DataFrame) -> np.ndarray:
    """Cost (-log probability) of a character class after two others, counted over all texts of docs.

    The table has 28 ** 3 cells whatever the corpus; the counts grow with it.
    """
    rows = docs.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(_SIZE**3)
    for gram, n in rows:
        count[gram] = n
    three = count.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + _SIZE)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 8 * p2) / (three.sum(2, keepdims=True) + 8)
    return -np.log(p3)


# -- decoding ---------------------------------------------------------------------------------


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """What each place of a disguised word may be read as, and the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    found = list(re.finditer(r"(.)\1*", word.lower(), re.DOTALL))
    sizes = [len(run[0]) for run in found if run[1] not in GAPS]
    halve = CUT if len(sizes) > 2 and 2 * sum(n > 1 for n in sizes) > len(sizes) else HALVE
    for run in found:
        c, n = run[1], len(run[0])
        if "a" <= c <= "z" or (ord(c) > 127 and c not in LEET):
            # A drawn-out or doubled letter was one or two.
            out.append([(c * n, 0.0)] if n == 1 else [(c, halve if n == 2 else CUT), (c * 2, 0.0 if n == 2 else CUT)])
            continue
        marks = LEET.get(c, "")
        if c in GAPS:
            # A gap that is kept ends a word; the model prices the boundary.
            out += [[(x, SWAP) for x in marks] + [("", DROP), (" ", DROP)]] * n
            continue
        end = TAIL if c == "!" and run.end() == len(word) else BREAK * min(n, 2)
        readings = [(x, SWAP + (0.0 if n == 1 else halve if n == 2 else CUT)) for x in marks] + [(" ", end)]
        if n > 1:
            readings += [(x + y, 2 * SWAP + (0.0 if n == 2 else CUT)) for x in marks for y in marks] + [(x + " ", SWAP + end) for x in marks] + [(" " + x, SWAP + end) for x in marks]
        if n == 3:
            readings += [(x + y + z, 3 * SWAP) for x in marks for y in marks for z in marks]
        out.append(readings)
    return out


def _number(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def decode(word: str, model: np.ndarray | list[float]) -> str:
    """The cheapest reading of a word: Viterbi over its lattice, with the last two characters as the state.

    model holds the costs of fit_characters, or is a flat list of them.
    """
    if isinstance(model, np.ndarray):
        model = model.ravel().tolist()
    # What was said so far is a chain of readings, so that the work is in proportion to the word.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for place in lattice(word):
        if len(states) == 1 and len(place) == 1 and place[0][0] not in ("", " "):
            # Nothing to choose: the cost is the same for all that follows.
            (((x, y), (cost, said)),) = states.items()
            for c in place[0][0]:
                x, y = y, _number(c)
            states = {(x, y): (cost, (said, place[0][0]))}
            continue
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, said) in states.items():
            for reading, price in place:
                x, y, total = a, b, cost + price
                for c in reading:
                    z = _number(c)
                    if z == 0 and y == 0:
                        continue
                    total += model[(x * _SIZE + y) * _SIZE + z]
                    x, y = y, z
                if total < nxt.get((x, y), (inf,))[0]:
                    nxt[x, y] = total, (said, reading)
        states = nxt
    said = min(((cost + model[(a * _SIZE + b) * _SIZE] * (b > 0), said) for (a, b), (cost, said) in states.items()), key=lambda x: x[0])[1]
    parts = []
    while said:
        said, reading = said
        parts.append(reading)
    return "".join(reversed(parts)).strip()


def _worth_halving(buf: np.ndarray, twice: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Marks doubled letters (at the second one) that decoding might read as one.

    A letter doubled once, with single ones around it, is read as one if the
    model gains more than HALVE by it; three or more in a row, and doubled
    letters side by side, are always marked.
    """
    hard = np.zeros(len(buf), bool)
    at = np.flatnonzero(twice)
    if not len(at):
        return hard
    word = np.searchsorted(starts, at, "right") - 1
    before, after = at - 2 >= starts[word], at + 1 < ends[word]
    c = _CLASS[buf[at]]
    x = np.where(before, _CLASS[buf[np.maximum(at - 2, 0)]], 0)
    y = np.where(after, _CLASS[buf[np.minimum(at + 1, len(buf) - 1)]], 0)
    gain = model[x, c, c] + model[c, c, y] - model[x, c, y]
    near = np.flatnonzero(np.diff(at) <= 2)
    hard[at] = gain >= HALVE
    hard[at[near]] = hard[at[near + 1]] = True
    return hard


def disguised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, model: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Words with a letter and a sign, an inner gap or a repeated letter, and runs (first word, last) of single characters.

    A run has three or more letters or signs, one of them a letter; gaps may
    stand between them. With a model, words of letters alone whose few doubled
    letters decode() would leave as they are don't count.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    letter, sign, gap = _LETTER[buf], _LEET_BYTE[buf], _GAP_BYTE[buf]
    if len(buf) > 2:
        euro = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x82) & (buf[2:] == 0xAC))
        sign[euro] = True
        for k in range(3):
            letter[euro + k] = False
    twice = np.zeros(len(buf), bool)
    twice[1:] = ((buf[1:] | 32) == (buf[:-1] | 32)) & (_CLASS[buf[1:]] % 27 > 0)
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, signs, repeats = before(letter), before(sign), before(twice)
    # Gaps at a word's ends are punctuation.
    at = np.arange(len(buf))
    a = np.minimum(np.minimum.accumulate(np.where(gap, len(buf), at)[::-1])[::-1][starts], ends)
    b = np.maximum(np.maximum.accumulate(np.where(gap, -1, at))[ends - 1] + 1, a)
    doubled = repeats[b] - repeats[np.minimum(a + 1, b)]
    drawn = doubled > 0
    if model is not None:
        hard = before(_worth_halving(buf, twice, starts, ends, model))
        first = np.minimum(np.minimum.accumulate(np.where(letter, at, len(buf))[::-1])[::-1][starts], ends)
        last = np.maximum(np.maximum.accumulate(np.where(letter, at, -1))[ends - 1] + 1, first)
        shown = letters[last] - letters[first] - doubled
        drawn &= (hard[b] > hard[a]) | (letters[last] - letters[first] < last - first) | ((2 * doubled > shown) & (shown > 2))
    odd = (letters[ends] > letters[starts]) & ((signs[b] > signs[a]) | drawn) & (b - a >= 2)
    size = ends - starts
    one = (size == 1) | ((size == 3) & sign[starts] & (buf[starts] == 0xE2))
    single = one & (letter[starts] | sign[starts])
    edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
    runs = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if hi - lo < 3:
            continue
        cuts = [lo, *(np.flatnonzero(np.diff(doc[lo:hi])) + lo + 1).tolist(), hi]
        for x, y in zip(cuts, cuts[1:], strict=False):
            members = np.flatnonzero(~gap[starts[x:y]]) + x
            if len(members) >= 3 and letter[starts[members]].any():
                runs.append((int(members[0]), int(members[-1]) + 1))
    return np.flatnonzero(odd), runs


class Restorer:
    """Decodes disguised words, each distinct one once in a task."""

    def __init__(self, model: np.ndarray):
        self.model, self.costs, self.known = model, model.ravel().tolist(), {}

    def __call__(self, word: str) -> str:
        if len(word) > REMEMBERED:
            return decode(word, self.costs)
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = decode(word, self.costs)
        return self.known[word]


# -- features -----------------------------------------------------------------------------------


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash of each word (without signs at its ends) and of its beginnings, with the text of each."""
    if not len(starts):
        return
    letter = _LETTER[buf]
    at = np.arange(len(buf))
    ahead = np.minimum.accumulate(np.where(letter, at, len(buf))[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(letter, at, -1))
    a, b = ahead[starts], behind[ends - 1] + 1
    real = (a < b) & (a < ends)
    a, b, doc = a[real], b[real], doc[real]
    yield C.hash_ranges(buf, a, b, C.BYTE_CODE_LOWER), doc
    for k in PREFIXES:
        longer = b - a > k
        yield C.mix(C.hash_ranges(buf, a[longer], a[longer] + k, C.BYTE_CODE_LOWER) + C.STEPS[40 + k]), doc[longer]


def _pieces(offsets: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Offsets with a long text parted after blanks."""
    if len(buf) <= 2 * PIECE:
        return offsets
    cuts = []
    for k in range(PIECE, len(buf), PIECE):
        blank = np.flatnonzero(C.SPACE[buf[k : k + PIECE]])
        if len(blank):
            cuts.append(k + int(blank[0]) + 1)
    return np.unique(np.concatenate([offsets, np.array(cuts, np.int64)]))


def _texts(batch: pa.RecordBatch, restore: Restorer) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """First and last row, words by text, and the features of the restored texts."""
    for lo, hi, buf, offsets in C.slices(C.rows_of(batch, "text"), 1 << 19):
        if hi - lo > 1:
            words, features = _restored(buf, offsets, restore)
        else:
            words, features = np.zeros(1, np.int64), []
            parted = _pieces(offsets, buf)
            for a, b in zip(parted[:-1].tolist(), parted[1:].tolist(), strict=True):
                more, found = _restored(buf[a:b], np.array([0, b - a]), restore)
                words = words + more
                features += found
        yield lo, hi, words, features


def _restored(buf: np.ndarray, offsets: np.ndarray, restore: Restorer) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    starts, ends, doc = C.words(buf, offsets)
    odd, runs = disguised(buf, starts, ends, doc, restore.model)
    said: list[tuple[int, str]] = []
    # Each distinct word once; those that are read as they stand stay where they are.
    _, first, same = np.unique(C.hash_ranges(buf, starts[odd], ends[odd], C.BYTE_CODE_LOWER), return_index=True, return_inverse=True)
    meant = []
    for k in odd[first].tolist():
        word = buf[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").lower()
        read = restore(word)
        meant.append(None if read == word.strip(string.digits + string.punctuation) else read)
    changed = np.array([m is not None for m in meant], bool)[same]
    odd, same = odd[changed], same[changed]
    said += [(doc[k], meant[m]) for k, m in zip(odd.tolist(), same.tolist(), strict=True)]
    for a, b in runs:
        said.append((doc[a], restore(buf[starts[a] : ends[b - 1]].tobytes().decode("utf-8", "replace"))))
    # Restored words count besides the rest; the words they come from don't.
    plain = np.ones(len(starts), bool)
    plain[odd] = False
    for a, b in runs:
        plain[a:b] = False
    features = list(_features(buf, starts[plain], ends[plain], doc[plain]))
    if said:
        said.sort(key=lambda x: x[0])
        encoded = [t.encode() + b" " for _, t in said]
        begin = np.concatenate([[0], np.cumsum([len(t) for t in encoded])])
        other = np.frombuffer(b"".join(encoded), np.uint8)
        s, e, which = C.words(other, begin)
        features += list(_features(other, s, e, np.array([d for d, _ in said])[which]))
    return np.bincount(doc, minlength=len(offsets) - 1), features


def _count_features(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_pylist(), np.int64)
            keys, labels = [], []
            for lo, _, _, features in _texts(batch, restore):
                for hashes, doc in features:
                    # Once for each text.
                    pair = np.unique(np.stack([doc.astype(np.uint64), hashes], 1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
                    keys.append(pair[:, 1])
                    labels.append(toxic[lo + pair[:, 0].astype(np.int64)])
            if keys:
                key, number = np.unique(np.concatenate(keys), return_inverse=True)
                bad = np.bincount(number, np.concatenate(labels), minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(number, minlength=len(key))), pa.array(bad)], ["feature", "n", "bad"])

    return run


class Scorer:
    """Selected features with a weight for presence and one for how often they come."""

    def __init__(self, features: np.ndarray, model: np.ndarray):
        self.features = np.sort(features)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.features >> np.uint64(48)).astype(np.int64)] = True
        self.model = model
        self.weights = np.zeros(2 * len(features))
        self.bias = 0.0

    def rows(self, words: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and how often it comes for 100 words, as log(1 + x)."""
        hits = []
        for hashes, doc in features:
            near = np.flatnonzero(self.filter[(hashes >> np.uint64(48)).astype(np.int64)])
            if len(near) and len(self.features):
                at = np.minimum(np.searchsorted(self.features, hashes[near]), len(self.features) - 1)
                same = self.features[at] == hashes[near]
                hits.append(doc[near[same]] * len(self.features) + at[same])
        pairs, count = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
        size = max(1, len(self.features))
        doc = pairs // size
        return doc, pairs % size, np.log1p(100 * count / np.maximum(words[doc], 10))

    def score(self, n: int, doc: np.ndarray, feature: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """Scores of n texts from rows(); a text without any feature says nothing of toxicity, however common that is, and gets CLEAN."""
        total = self.bias + np.bincount(doc, self.weights[feature] + self.weights[feature + len(self.features)] * rate, minlength=n)
        return np.where(np.bincount(doc, minlength=n) > 0, 1 / (1 + np.exp(-np.clip(total, -30, 30))), CLEAN)

    def fit(self, label: np.ndarray, doc: np.ndarray, feature: np.ndarray, rate: np.ndarray, rounds: int = 400, pace: float = 0.2, decay: float = 2e-4) -> None:
        """Logistic regression by gradient steps, each weight with a pace of its own.

        Where more than MOST_TOXIC of the labels are toxic, blank clean texts fill up to that share: labels are
        often picked to be balanced, and a text that says little should not start out as toxic.
        """
        toxic = float(label.sum())
        label = np.append(label, np.zeros(max(0, int(toxic / MOST_TOXIC) - len(label))))
        n, k = len(label), len(self.features)
        rows, columns, values = np.concatenate([doc, doc]), np.concatenate([feature, feature + k]), np.concatenate([np.ones(len(doc)), rate])
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        w, b = np.zeros(2 * k), log(share / (1 - share))
        speed = np.zeros(2 * k + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns] * values, minlength=n) + b, -30, 30)))
            error = (p - label) / n
            grad = np.append(np.bincount(columns, error[rows] * values, minlength=2 * k) + decay * w, error.sum())
            speed += grad**2
            change = pace * grad / np.sqrt(speed + 1e-12)
            w, b = w - change[:-1], b - change[-1]
        self.weights, self.bias = w, float(b)


def _rows_for_fit(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(scorer.model)
        for batch in batches:
            toxic = batch.column("toxic")
            for lo, hi, words, features in _texts(batch, restore):
                doc, feature, rate = scorer.rows(words, features)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [toxic.slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(rate))], ["toxic", "feature", "rate"]
                )

    return run


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(scorer.model)
        for batch in batches:
            for lo, hi, words, features in _texts(batch, restore):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(scorer.score(hi - lo, *scorer.rows(words, features)))], [*batch.schema.names, "__tl_score"])

    return run


def fit_scorer(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> Scorer:
    """Fits the score on docs (doc_id, text) and labelled (doc_id, toxic 0 or 1).

    The characters' model counts every text. Labels: the rows (at most the bound)
    with the smallest id hashes; their ids, a table of that bounded size, are
    broadcast, so texts don't shuffle. An id with several labels counts as toxic
    if one says so; null labels and ids teach nothing. Without labels every text
    scores the same low value.
    """
    model = fit_characters(docs)
    clean = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = C.materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    counts = texts.mapInArrow(_count_features(model), "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_TEXTS)
    total, bad = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total or not bad:
        return _constant(model)
    share = bad / total
    # Chi-squared of a feature with the label, one degree of freedom.
    chi = (F.col("bad") - F.col("n") * share) ** 2 / (F.col("n") * (share * (1 - share)) * (1 - F.col("n") / (total + 1.0)) + 1e-9)
    best = counts.orderBy(F.desc(chi), "feature").limit(features).select("feature").toPandas()["feature"].to_numpy(np.int64)
    scorer = Scorer(best.view(np.uint64), model)
    got = texts.mapInArrow(_rows_for_fit(scorer), "toxic long, feature array<int>, rate array<double>").toPandas()
    sizes = got["feature"].map(len).to_numpy()
    join = lambda c, t: np.concatenate([np.asarray(x, t) for x in got[c]]) if len(got) else np.zeros(0, t)
    scorer.fit(got["toxic"].to_numpy(float), np.repeat(np.arange(len(got)), sizes), join("feature", np.int64), join("rate", float))
    return scorer


def _constant(model: np.ndarray) -> Scorer:
    scorer = Scorer(np.zeros(0, np.uint64), model)
    scorer.bias = -5.0
    return scorer


def score_texts(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """docs with the score in (0, 1) in a new column, which takes the place of one of that name.

    An empty table gives no rows; other columns pass through under any name. Null, empty and letterless texts, as all without a feature, score CLEAN. Rows are
    scored alone, whole and of any length (letters spaced out across the parting
    of a text above 2 MB are read as two runs); repeated rows have equal scores.
    """
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField("__tl_score", T.DoubleType())])
    return docs.mapInArrow(_score(scorer), schema).withColumnRenamed("__tl_score", column)


def toxicity(docs: DataFrame, labelled: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labels that aren't held out, scores every row.

    Held out are the ids whose crc32, as decimal text, is held_fold modulo folds
    (a null id counts as the empty string).
    """
    taught = labelled.where(C.id_crc32(F.col("doc_id")) % folds != held_fold)
    scorer = fit_scorer(docs, taught)
    held = C.id_crc32(F.col("doc_id")) % folds == held_fold
    return score_texts(docs.select("doc_id", "text"), scorer).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, labelled: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns.

    Null, empty and letterless texts stay whatever the labels; repeated rows stay or go
    together; an empty table gives no rows, and without toxic labels all rows stay.
    """
    scorer = fit_scorer(docs, labelled.where(C.id_crc32(F.col("doc_id")) % folds != held_fold))
    return score_texts(docs, scorer, "__tl_score").where(F.col("__tl_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
