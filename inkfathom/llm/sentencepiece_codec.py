"""SentencePiece models on the tokenizers library: parse the model file, rebuild the tokenizer, encode, decode, verify.

The protobuf is read field by field. Pieces with their scores become a Unigram model, or, where the trainer made a BPE
model, merges in the order of scores: each split of a piece into two pieces is a merge of its rank, and of pieces with
one score the longer go first, which is how the reference, going from the left, comes to merge runs of spaces. The
normaliser (character map, extra white space, dummy prefix, metaspace marker) and byte fallback are the library's own
parts, as the model says.

Where no piece has a marker or a line end beside another character, as here, a normalised text's ids are those of its
segments (markers and what follows them, and line ends) in turn; each distinct segment of a batch is encoded once, in
multithreaded batches, and remembered. Else every text is one segment. The ids are the rebuilt tokenizer's; the reference
library only verifies: it encodes every whole text, and `parity` tells whether its ids are the same. Decoding joins the
bytes of pieces.

Null and empty texts have no ids; every other string round-trips with an identity normaliser, but that a marker becomes a
space; texts of any length are encoded whole, ties and repeated rows get equal rows, null ids stay null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .idstore import IdStore, parallel, ragged

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_PART = "\x1f"
#: Segments that a Python worker remembers, and encodes at once; threads of a worker.
SEGMENTS, AT_ONCE, THREADS = 700_000, 8_192, 2
#: Texts that the reference library verifies at once.
VERIFIED = 64


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; numbers of fixed width as bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 2, 5):
            size, at = _varint(raw, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is unknown")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    charsmap: bytes = b""

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            raw = f.read()
        out = cls([], [], [])
        for number, value in _fields(raw):
            if number == 1:  # a piece: text, score, kind
                own = dict(_fields(value))
                out.pieces.append(own[1].decode())
                out.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                out.kinds.append(own.get(3, NORMAL))
            elif number == 2:  # the trainer's settings
                own = dict(_fields(value))
                out.model_type, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:  # the normaliser's
                own = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
                if not own.get(5, 1):
                    raise ValueError("models that do not mark white space are not supported")
        return out

    def normalizer(self):
        """The normaliser, of the library's parts: what a text is before it is encoded."""
        from tokenizers import Regex, normalizers

        parts = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            parts += [normalizers.Replace(Regex("^[ ▁]+|[ ▁]+$"), ""), normalizers.Replace(Regex("[ ▁]{2,}"), " ")]
        if self.dummy_prefix:
            parts.append(normalizers.Prepend(MARK))
        return normalizers.Sequence([*parts, normalizers.Replace(" ", MARK)])

    def tokenizer(self, normalize: bool = True):
        """A tokenizer of the tokenizers library for whole texts, or for segments that are normalised already."""
        from tokenizers import Tokenizer, decoders, models

        if self.model_type == UNIGRAM:
            out = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores)), unk_id=self.kinds.index(UNKNOWN), byte_fallback=self.byte_fallback))
        else:
            usable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED)}
            merges = []
            for p, i in usable.items():
                merges += [(-self.scores[i], -len(p), -k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges.sort()
            out = Tokenizer(models.BPE({p: i for i, p in enumerate(self.pieces)}, [m[3:] for m in merges], unk_token=self.pieces[self.kinds.index(UNKNOWN)], byte_fallback=self.byte_fallback, fuse_unk=True))
        if normalize:
            out.normalizer = self.normalizer()
            strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
            out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out

    def splits(self) -> bool:
        """Whether no piece has a marker after another character, or a line end beside one."""
        return all(MARK not in p.lstrip(MARK) and ("\n" not in p or p == "\n") for p in self.pieces)

    def piece_bytes(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]


def marked(text: str | None, dummy_prefix: bool = True) -> str:
    """A text as an identity normaliser leaves it: markers in place of spaces."""
    return ((MARK if dummy_prefix else "") + text).replace(" ", MARK) if text else ""


def split_segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Segments of each marked text, as (code of each, first of each text and the end, distinct segments by code)."""
    if any(_PART in t for t in texts):  # rare: a text has the separator itself
        lists = pa.array([re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", t) for t in texts], pa.large_list(pa.large_string()))
    else:
        parted = [re.sub(f"({MARK}+)", _PART + r"\1", t) if MARK + MARK in t else t.replace(MARK, _PART + MARK) for t in texts]
        lists = pc.split_pattern(pa.array([t.replace("\n", f"{_PART}\n{_PART}") for t in parted], pa.large_string()), _PART)
    flat, ends = lists.values, np.asarray(lists.offsets)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[ends].astype(np.int64), coded.dictionary.to_pylist()


class Codec:
    def __init__(self, path: str, verify: bool = True):
        self.model = Model.read(path)
        self.tokenizer, self.normalizer = self.model.tokenizer(normalize=False), self.model.normalizer()
        self.store = IdStore(self._learn, SEGMENTS, AT_ONCE)
        self.splits, self.reference = self.model.splits(), None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = self.model.piece_bytes()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.bytes_size = np.array([len(x) for x in raw], np.int64)
        self.bytes_first = np.cumsum(self.bytes_size) - self.bytes_size

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each segment."""
        with parallel(True):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in turn, where each text's begin and the end, and whether the reference library gives the same for the whole text."""
        whole = [self.normalizer.normalize_str(t or "") for t in texts]
        if self.splits:
            codes, ends, distinct = split_segments(whole)
        else:
            distinct = list(dict.fromkeys(whole))
            place = {t: i for i, t in enumerate(distinct)}
            codes, ends = np.array([place[t] for t in whole], np.int64), np.arange(len(whole) + 1)
        ids, upto = self.store.gather(self.store.numbers(distinct)[codes])
        bounds = upto[ends]
        return ids, bounds, self._parity(texts, ids, bounds)

    def _parity(self, texts: list[str | None], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.reference is None:
            return np.ones(len(texts), bool)
        out = np.zeros(len(texts), bool)
        for at in range(0, len(texts), VERIFIED):
            theirs = self.reference.encode([t or "" for t in texts[at : at + VERIFIED]], num_threads=THREADS)
            for k, other in enumerate(theirs, at):
                own = ids[bounds[k] : bounds[k + 1]]
                out[k] = len(own) == len(other) and bool((own == np.fromiter(other, np.int32, len(other))).all())
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        raw, upto = ragged(self.bytes, self.bytes_first[ids], self.bytes_size[ids])
        raw, cuts = raw.tobytes(), upto[ends]
        skip = 1 if self.model.dummy_prefix else 0
        return [(x[skip:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in (raw[a:b] for a, b in zip(cuts, cuts[1:]))]


@lru_cache(2)
def codec(path: str, verify: bool) -> Codec:
    """One codec for all tasks of a Python worker."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(path, verify)


def encode(docs: DataFrame, path: str, verify: bool = True, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip, parity (and ids) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, verify)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids, ends, parity = own.encode(texts)
            back = own.decode(ids, ends)
            raw = ids.astype("<u4")
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(ends)),
                pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64()),
                pa.array([x == (t or "") for x, t in zip(back, texts)], pa.bool_()),
                pa.array(parity),
            ]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"] + ["ids"] * keep_ids)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * keep_ids)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows(doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, False)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            texts = own.decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
