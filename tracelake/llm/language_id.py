"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes, counted on Spark
over all of its learning texts. The counts are then frozen: a text's exact code
length under a tree is the sum, over its bytes, of the cost of the byte in the
longest known context, plus an escape for every longer known context that
didn't have it. The shortest code names the language.

No count is left out. The costs are worked out on Spark, and those of the two
longest contexts, which grow with the text, are a file that tasks map into memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C

ORDER = 3
#: Bytes of evidence after which the score doesn't grow sharper.
EVIDENCE = 32
_SYM = np.zeros(256, np.uint32)  # 0: anything that isn't a letter
_SYM[97:123] = np.arange(1, 27)
_SYM[65:91] = np.arange(1, 27)
_SYM[128:] = np.arange(27, 155)
SYMBOLS = 155
#: Arrays of a level, and how they are stored.
_PARTS = {"grams": np.int64, "cost": np.float32, "contexts": np.int64, "escape": np.float32}


def _symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text led by ORDER zeros, and the new offsets."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros(len(buf) + ORDER * n, np.uint32)
    out[np.arange(len(buf)) + np.repeat(ORDER * np.arange(1, n + 1), sizes)] = _SYM[buf]
    return out, offsets + ORDER * np.arange(n + 1)


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its ORDER + 1 symbols as one number, and the symbol numbers' text."""
    sym, at = _symbols(buf, offsets)
    code = sym[:-ORDER].copy() if len(sym) > ORDER else np.zeros(0, np.uint32)
    for k in range(1, ORDER + 1):
        code = code * np.uint32(SYMBOLS) + sym[k : len(sym) - ORDER + k]
    # A text's own grams begin in its leading zeros and end at its last byte.
    keep = np.ones(len(code), bool)
    for k in range(ORDER):
        inner = at[1:-1] - ORDER + k
        keep[inner[(inner >= 0) & (inner < len(code))]] = False
    return code[keep], offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, codes: np.ndarray, n: np.ndarray) -> None:
        if lang in held:
            codes, n = np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], n])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            codes, n = codes[first], np.add.reduceat(n, first)
        held[lang] = codes, n

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = C.rows_of(batch, "text")
        for lang in sorted(set(langs)):
            mine = texts.filter(pa.array(langs == lang))
            for _, _, buf, offsets in C.slices(mine, 4 << 20):
                codes = np.sort(_grams(buf, offsets)[0])
                if len(codes):
                    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                    add(lang, codes[first], np.diff(np.append(first, len(codes))))
    for lang, (codes, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _level(k: int, size: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order k's grams, their cost by language, contexts and their escape; below: grams and cost of order k - 1."""
    grams, own = np.unique(gram % SYMBOLS ** (k + 1), return_inverse=True)
    contexts, of = np.unique(grams // SYMBOLS, return_inverse=True)
    count = np.zeros((len(grams), size))
    np.add.at(count, (own, lang), n)
    total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
    np.add.at(total, of, count)
    np.add.at(kinds, of, count > 0)
    known = total > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        # Escape probability: distinct symbols over occurrences plus distinct symbols.
        escape = np.where(known, -np.log2(np.where(known, kinds / (total + kinds), 1.0)), 0.0)
        cost = -np.log2(count / (total + kinds)[of])
    shorter = below[1][np.searchsorted(below[0], grams % SYMBOLS**k)] if below else np.full((len(grams), size), np.log2(256.0))
    return grams, np.where(count > 0, cost, escape[of] + shorter), contexts, escape


def _keys(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of order-k grams and of their contexts in the order of the tables: by the two symbols before the last first."""
    if k < ORDER:
        return gram, gram // SYMBOLS
    pair, first = gram // SYMBOLS % SYMBOLS**2, gram // SYMBOLS**ORDER
    return (pair * SYMBOLS + first) * SYMBOLS + gram % SYMBOLS, pair * SYMBOLS + first


def _long_levels(number: dict[str, int], below: tuple[np.ndarray, np.ndarray], pairs: int):
    """Orders 2 and 3 of the grams whose two symbols before the last are in one range; no other gram shares their contexts."""
    size = len(number)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lang, gram, n = rows["lang"].map(number).to_numpy(np.int64), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        out, shorter = {"range": [int(gram[0] // SYMBOLS % SYMBOLS**2 // pairs)]}, below
        for k in range(2, ORDER + 1):
            grams, cost, contexts, escape = _level(k, size, lang, gram, n, shorter)
            shorter = grams, cost
            key = _keys(grams, k)[0]
            at = _keys(contexts * SYMBOLS, k)[1]
            order, by = np.argsort(key), np.argsort(at)
            for name, x in (("grams", key[order]), ("cost", cost[order]), ("contexts", at[by]), ("escape", escape[by])):
                out[f"{name}_{k}"] = [x.astype(_PARTS[name]).tobytes()]
        return pd.DataFrame(out)

    return run


class Trees:
    """Frozen counts of all languages, as cost tables for each context length.

    Orders 0 and 1 are held; the longer ones are files of this name among the job's files.
    """

    def __init__(self, langs: list[str], levels: list[tuple[np.ndarray, ...]], name: str):
        self.langs, self.held, self.name = langs, levels, name

    @property
    def levels(self) -> list[tuple[np.ndarray, ...]]:
        if "_levels" not in self.__dict__:
            self._levels = self.held + [tuple(self._mapped(part, k) for part in _PARTS) for k in range(2, ORDER + 1)]
        return self._levels

    def _mapped(self, part: str, k: int) -> np.ndarray:
        path = SparkFiles.get(f"{self.name}-{part}-{k}")
        flat = np.memmap(path, _PARTS[part], "r") if os.path.getsize(path) else np.zeros(0, _PARTS[part])
        return np.asarray(flat).reshape((-1, len(self.langs)) if part in ("cost", "escape") else -1)

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last symbol after the others, by language."""
        own, at = np.unique(gram, return_inverse=True)
        return self._cost(own, ORDER)[at]

    def _cost(self, gram: np.ndarray, k: int) -> np.ndarray:
        if k < 0:
            return np.full((len(gram), len(self.langs)), np.float32(8))
        grams, cost, contexts, escape = self.levels[k]
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        if not len(gram) or not len(grams):
            return out
        key, context = _keys(gram, k)
        at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        known = grams[at] == key
        out[known] = cost[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            at = np.minimum(np.searchsorted(contexts, context[rest]), len(contexts) - 1)
            out[rest] = np.where((contexts[at] == context[rest])[:, None], escape[at], np.float32(0)) + self._cost(gram[rest] % SYMBOLS**k if k else gram[rest], k - 1)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_levels"}


def fit_trees(docs: DataFrame) -> Trees:
    """Counts docs (lang, text) into trees; rows with a null lang teach nothing.

    All texts and all grams count. The driver holds orders 0 and 1, at most
    SYMBOLS ** 2 rows for each language; the tables of the longer ones pass
    through it part by part into files that go to every executor.
    """
    counts = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = C.materialize(counts)
    short = counts.groupBy("lang", (F.col("gram") % SYMBOLS**2).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(short["lang"].unique())
    name = f"trees-{uuid.uuid4().hex}"
    if not langs:
        return Trees([], [], name)
    number = {lang: k for k, lang in enumerate(langs)}
    below, held = None, []
    for k in range(2):
        level = _level(k, len(langs), short["lang"].map(number).to_numpy(np.int64), short["gram"].to_numpy(np.int64), short["n"].to_numpy(np.int64), below)
        below = level[:2]
        held.append(tuple(x.astype(t) for x, t in zip(level, _PARTS.values(), strict=True)))
    pairs = max(1, 32 // len(langs))
    fields = [f"{part}_{k}" for k in range(2, ORDER + 1) for part in _PARTS]
    ranged = counts.groupBy(F.expr(f"((gram div {SYMBOLS}) % {SYMBOLS**2}) div {pairs}").alias("range"))
    tables = C.materialize(ranged.applyInPandas(_long_levels(number, below, pairs), "range long, " + ", ".join(f"{f} binary" for f in fields)))
    megabytes = tables.select(F.sum(sum((F.length(f) for f in fields), F.lit(0)))).first()[0] >> 20
    folder = tempfile.mkdtemp(prefix="tracelake-")
    paths = {f: os.path.join(folder, f"{name}-{f.replace('_', '-')}") for f in fields}
    files = {f: open(path, "wb") for f, path in paths.items()}
    for row in tables.repartitionByRange(megabytes // 32 + 1, "range").sortWithinPartitions("range").toLocalIterator():
        for f in fields:
            files[f].write(row[f])
    for f in fields:
        files[f].close()
        docs.sparkSession.sparkContext.addFile(paths[f])
    return Trees(langs, held, name)


def _bits(trees: Trees, buf: np.ndarray, offsets: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """Code length of each text under each language's tree; a long text is summed piece by piece."""
    grams = _grams(buf, offsets)[0]
    if len(offsets) == 2:
        parts = [trees.cost(grams[k : k + piece].astype(np.int64)).sum(0, dtype=np.float64) for k in range(0, len(grams), piece)]
        return np.sum(parts or [np.zeros(len(trees.langs))], axis=0)[None]
    sums = np.zeros((len(buf) + 1, len(trees.langs)))
    np.cumsum(trees.cost(grams.astype(np.int64)), axis=0, dtype=np.float64, out=sums[1:])
    return np.diff(sums[offsets], axis=0)


def _predict(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bytes that are looked up together: their costs are a row of all languages each.
        piece = max(1 << 12, (1 << 20) // max(1, len(trees.langs)))
        for batch in batches:
            texts = C.rows_of(batch, "text")
            for lo, hi, buf, offsets in C.slices(texts, min(piece, 1 << 18)):
                sizes = np.diff(offsets)
                ascii_letter = np.concatenate([[0], np.cumsum((_SYM[buf] > 0) & (buf < 128))])[offsets]
                letters = np.diff(ascii_letter) > 0
                for k in np.flatnonzero(~letters & (sizes > 0)):
                    letters[k] = any(map(str.isalpha, texts[lo + int(k)].as_py()))
                if trees.langs:
                    bits = _bits(trees, buf, offsets, min(piece, 1 << 18))
                    best = bits.argmin(1)
                    excess = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))[:, None]
                    score = 1 / np.exp2(-excess).sum(1)
                else:
                    best, letters, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool), np.zeros(hi - lo)
                named = [trees.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(named, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    A text that is null or has no letter is `und` with score 0; so is every text
    if there is nothing to learn from. Ties go to the language whose name comes
    first. score is the language's share of 2 ** -bits, with the bits of long
    texts scaled to EVIDENCE bytes.
    """
    return docs.select("doc_id", "text").mapInArrow(_predict(trees), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the rows that aren't held out, predicts all.

    A row is held out if crc32 of its decimal id, modulo folds, is held_fold (a
    null id counts as the empty string and so is held out). Repeated rows have
    equal results; an empty table gives no rows; columns but doc_id, text and
    lang may have any name.
    """
    held = C.id_crc32(F.col("doc_id")) % folds == held_fold
    trees = fit_trees(docs.where(~held).select("lang", "text"))
    return predict_languages(docs, trees).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


