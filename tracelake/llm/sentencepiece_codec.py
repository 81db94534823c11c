"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a whitespace marker after another character, so the
segmentation of a text is that of its marked words (a run of markers and the
characters up to the next marker), one by one. Each block of texts is cut to
marked words; each distinct one is segmented once, by the library, into a table
of ids; the ids join back by the words' positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C

MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
#: Distinct words a task keeps from block to block; above it the table starts anew.
TABLE_LIMIT = 300_000
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20


@lru_cache(maxsize=2)
def _library(model_path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=2)
def _pieces_end_words(model_path: str) -> bool:
    """Whether no piece crosses into a whitespace marker, which the table needs."""
    library = _library(model_path)
    return not any(MARK in library.id_to_piece(k).lstrip(MARK) for k in range(library.get_piece_size()))


class ChunkTable:
    """Ids of each distinct marked word seen so far, back to back in one array."""

    def __init__(self, model_path: str):
        if not _pieces_end_words(model_path):
            raise ValueError("pieces of this model cross whitespace markers")
        self.library = _library(model_path)
        self.mark_id = self.library.piece_to_id(MARK)
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def add(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.number]
        if not new:
            return
        # The library puts a marker of its own before a text, so each word goes in without its first.
        found = self.library.encode([c[1:] for c in new], num_threads=1)
        found = [x if c != " " else [self.mark_id] for c, x in zip(new, found, strict=True)]
        start = len(self.number)
        self.number.update(zip(new, range(start, start + len(new)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their ids back to back."""
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.number) > TABLE_LIMIT:
            self.number, self.ids, self.begin = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.add(set().union(*cut))
        number = self.number
        rows = np.fromiter((number[c] for chunks in cut for c in chunks), np.int64)
        sizes = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        chunk_ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        return np.concatenate([[0], ends])[chunk_ends], self.ids[at]


def _encoder(model_path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            texts = C.rows_of(batch, "__tl_text")
            for lo, hi, _, _ in C.slices(texts, BLOCK_BYTES):
                offsets, ids = table.encode(texts.slice(lo, hi - lo).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), lists], [*keep, "ids"])

    return run


@lru_cache(maxsize=2)
def _piece_bytes(model_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes back to back, where each begins, and whether it stands for plain bytes."""
    library = _library(model_path)
    out, plain = [], np.ones(library.get_piece_size(), bool)
    for k in range(library.get_piece_size()):
        if library.is_byte(k):
            out.append(bytes([int(library.id_to_piece(k)[3:-1], 16)]))
        else:
            out.append(library.id_to_piece(k).replace(MARK, " ").encode())
            plain[k] = not (library.is_control(k) or library.is_unknown(k) or library.is_unused(k))
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])]), plain


def decode_ids(model_path: str, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of lists of ids, as the library's decode gives them."""
    raw, begin, plain = _piece_bytes(model_path)
    sizes = begin[ids + 1] - begin[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    data = raw[at].tobytes()
    ends = np.concatenate([[0], ends])[offsets]
    odd = np.concatenate([[0], np.cumsum(~plain[ids])])[offsets]
    out = []
    for k in range(len(offsets) - 1):
        text = data[ends[k] : ends[k + 1]]
        try:
            if odd[k + 1] > odd[k]:
                raise ValueError("pieces with a text of their own")
            # A byte piece for a space isn't a marker, and so isn't taken off at the start.
            first = ids[offsets[k]] if offsets[k + 1] > offsets[k] else 0
            marked = text[:1] == b" " and begin[first + 1] - begin[first] >= 1 and not _library(model_path).is_byte(int(first))
            out.append(text[1 if marked else 0 :].decode())
        except ValueError:
            out.append(_library(model_path).decode(ids[offsets[k] : offsets[k + 1]].tolist()))
    return out


def _decoder(model_path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = np.asarray(lists.offsets, np.int64)
            begin = 0
            while begin < len(lists):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, "right")) - 1)
                end = min(end, len(lists))
                ids = lists.values.slice(offsets[begin], offsets[end] - offsets[begin]).to_numpy(zero_copy_only=False)
                texts = decode_ids(model_path, ids, offsets[begin : end + 1] - offsets[begin])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, end - begin) for c in [*keep, "ids"]), pa.array(texts, pa.string())], [*keep, "ids", "decoded"])
                begin = end

    return run


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The keep columns and ids array<int> for every row of docs: the library's ids, without begin or end.

    Null text counts as empty; empty text has no ids. Rows stay as they are,
    repeated or not; a text of any length is one list; an empty table gives no
    rows. A kept column called ids gives its place to the new one. model_path must be a file
    that every executor has, with pieces that don't cross whitespace markers
    (ValueError otherwise).
    """
    types = dict(docs.dtypes)
    keep = [c for c in keep if c != "ids"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__tl_text")).mapInArrow(_encoder(model_path, keep), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (with ids array<int>) and decoded string, as the library's decode(ids) gives it."""
    keep = [c for c in encoded.columns if c != "ids"]
    types = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>", "decoded string"])
    return encoded.mapInArrow(_decoder(model_path, keep), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what decode() returns."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
