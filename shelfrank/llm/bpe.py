"""Byte-level BPE through a sentencepiece model written straight from a rank file.

The model is serialised here, field by field: piece number r is the rank file's entry r with each byte mapped to one
character, scored -r, under identity normalisation, so that sentencepiece merges in rank order. Pre-tokens are encoded
one by one, all of them by sentencepiece; a worker remembers the ids of short ones. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, pieces

#: Pre-tokens whose ids a worker remembers, and the longest of them in characters.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 40
#: Byte b stands as this character: a letter of two UTF-8 bytes, never a blank or sentencepiece's own mark.
_MAPPED = [chr(0x100 + b) for b in range(256)]
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """Entries by rank of a file of base64 entries and ranks."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_bytes(ranks: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece r is entry r; the unknown piece comes last."""
    body = b"".join(_piece("".join(_MAPPED[b] for b in entry), -float(r), _NORMAL) for r, entry in enumerate(ranks))
    body += _piece("<unk>", 0.0, _UNKNOWN)
    unset = (1 << 64) - 1  # -1: no begin, end or padding piece
    trainer = _number(3, _BPE) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + b"".join(_number(f, unset) for f in (41, 42, 43))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _block(2, trainer) + _block(3, normalizer)


class Coder:
    """Encodes and decodes with a model's bytes; remembers the ids of short pre-tokens."""

    def __init__(self, ranks: list[bytes], model: bytes, pattern: str):
        self.entries = ranks
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, bytes] = {}

    def _look_up(self, tokens: set[str]) -> dict[str, bytes]:
        own = list(tokens)
        found = self.model.encode([t.encode().decode("latin-1").translate(_TO_MAPPED) for t in own], out_type=int, num_threads=1)
        return {t: np.array(ids, "<u4").tobytes() for t, ids in zip(own, found, strict=True)}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for text in texts:
            tokens = self.split(text or "")
            new = set(tokens).difference(self.known)
            if new:
                found = self._look_up(new)
                if len(self.known) > CACHE_ENTRIES:
                    self.known.clear()
                    found |= self._look_up(set(tokens).difference(found))
                self.known |= {t: i for t, i in found.items() if len(t) <= CACHE_CHARS}
                long = {t: i for t, i in found.items() if len(t) > CACHE_CHARS}
                yield b"".join([self.known[t] if t in self.known else long[t] for t in tokens]) if long else b"".join(map(self.known.__getitem__, tokens))
            else:
                yield b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_TO_MAPPED = {b: _MAPPED[b] for b in range(256)}


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, real: bool = False) -> DataFrame:
    """(id, keep..., n_tokens, ids_sha256, decoded_sha256), and with real the ids and the decoded text as well.

    A row for each row of docs; a null text is empty. path: the rank file, read on the driver only. keep: columns to
    carry along; one named like those or "text" is an error. Repeated rows are repeated; texts of any length are encoded whole; an empty
    table gives no row.
    """
    ranks, keep = read_ranks(path), carried(keep, "id", "text", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if real else []))
    held = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "model": model_bytes(ranks)})  # fixed by the rank file
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    new = ["0L n_tokens", "'' ids_sha256", "'' decoded_sha256", *(["array(0) ids", "'' decoded"] if real else [])]
    out = rows.drop("text").selectExpr("*", *new).schema

    def digests(parts: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value  # a worker's own copy, which keeps the coder from task to task
        if "coder" not in state:
            state["coder"] = Coder(state["ranks"], state["model"], pattern)
        coder = state["coder"]
        for batch in batches:
            for run in pieces(batch, 128):
                ids = list(coder.encode(run.column("text").to_pylist()))
                back = list(map(coder.decode, ids))
                cols = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_sha256": digests(ids), "decoded_sha256": digests(back)}
                if real:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32()), flat)
                    cols["decoded"] = pa.array([b.decode() for b in back], pa.string())
                yield pa.RecordBatch.from_arrays([cols[c] if c in cols else run.column(c) for c in out.names], out.names)

    return rows.mapInArrow(over, out)
