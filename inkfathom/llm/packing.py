"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by exact-complement hashing.

Documents become pieces of at most `capacity` ids. The plan is made from the histogram of piece lengths alone (at most
`capacity` entries, however many documents there are): for each length, longest first, an index over single, pair and
triple sums finds what fills the gap exactly, as often as the counts allow; what is left is packed best-fit. Each
pattern takes ranges of ranks within its lengths, so a piece finds its sequence from its length and its rank. Ranks are
counted within salted buckets of a length, so that a length shared by a third of all pieces is still ranked by many tasks.

Null and empty texts become the closing id alone; very long texts are cut into pieces of `capacity`, whole; equal documents
and rows that repeat an id are packed each for itself, ties in rank by bucket, id and piece; rows without id are packed as
others; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, slices, split_words, table
from .idstore import IdStore, parallel

CAPACITY = 2048
#: Rows that one bucket of a length is meant to hold, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256
#: Parts of texts whose ids a Python worker remembers.
CACHE_PARTS = 400_000


class WordEncoder:
    """Ids of texts, exactly as the tokenizer gives them for the whole text.

    The tokenizer lower-cases, and its pre-tokens span neither white space nor the place between a letter or digit and
    punctuation other than an apostrophe. So texts are cut there, and each distinct part of a batch is encoded once;
    parts met before are remembered. Texts near a special token's opening are cut at white space alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = IdStore(self._learn, CACHE_PARTS)

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        with parallel(False):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and where each text's ids begin, and the end."""
        codes, ends, distinct = split_words(*_parted(texts))
        ids, upto = self.store.gather(self.store.numbers(distinct.to_pylist())[codes])
        return ids.view(np.uint32), upto[ends]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def _parted(texts: pa.Array) -> tuple[pa.Array, bool]:
    """The texts with a space before punctuation that follows a letter or digit, and whether they may be lower-cased."""
    texts = pa.array(texts.to_pylist(), pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    raw = data.to_pybytes() if data is not None else b""
    if b"<|" in raw:
        return texts, False
    raw = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_PUNCTUATION[raw[1:]]) + 1
    at = at[_ALNUM[raw[at - 1]]]
    old = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    new = old + np.searchsorted(at, old, "left")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(new.tobytes()), pa.py_buffer(np.insert(raw, at, 32).tobytes())), True


_PUNCTUATION, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document, closing id included."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, end = encoder(tokenizer), np.array([closing_id], "<u4")
        for batch in slices(batches, max_bytes=2 << 20):
            ids, upto = own_encoder.encode(batch.column("text"))
            rows: list[tuple] = []
            kept = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.concatenate([ids[upto[k] : upto[k + 1]].astype("<u4", copy=False), end])
                for p, a in enumerate(range(0, len(own), capacity)):
                    part = own[a : a + capacity]
                    rows.append((doc, p, a, len(part), zlib.crc32(part.tobytes())))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return id_and_text(docs).mapInArrow(cut, schema)


class _Index:
    """Finds one, two or three available lengths with a given sum.

    Availability only falls, so the place where a sum's search stopped never has to move back.
    """

    def __init__(self, count: np.ndarray):
        self.count = count
        self.pair_at = np.arange(len(count))  # the larger of a pair, by sum
        self.triple_at = np.arange(len(count))

    def feasible(self, *lengths: int) -> bool:
        return all(self.count[x] >= n for x, n in Counter(lengths).items())

    def pair(self, total: int, most: int | None = None) -> tuple[int, int] | None:
        a = min(self.pair_at[total], total - 1)
        while 2 * a >= total:
            if self.count[a] and self.count[total - a] and (a != total - a or self.count[a] > 1):
                self.pair_at[total] = a
                return int(a), int(total - a)
            a -= 1
        self.pair_at[total] = a
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        if self.count[gap]:
            return (gap,)
        if gap > 1 and (two := self.pair(gap)):
            return two
        c = min(self.triple_at[gap], gap - 2)
        while c >= 1:
            if self.count[c] and (two := self.pair(gap - c)) and self.feasible(c, *two):
                break
            c -= 1
        # Only lengths without any piece are passed for good: a pair that takes c itself may differ later.
        top = min(self.triple_at[gap], gap - 2)
        while top > c and not self.count[top]:
            top -= 1
        self.triple_at[gap] = max(top, 0)
        return (int(c), *two) if c >= 1 else None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), from the number of pieces of each length."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if count[capacity]:
        out.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    index = _Index(count)
    left: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while count[length]:
            count[length] -= 1  # one is placed: the filling comes from the others
            rest = index.filling(capacity - length)
            count[length] += 1
            if not rest:
                left[length] = int(count[length])
                count[length] = 0
                break
            needs = Counter((length, *rest))
            times = min(int(count[x]) // n for x, n in needs.items())
            for x, n in needs.items():
                count[x] -= n * times
            out.append(((length, *rest), times))
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # open sequences by gap
    for length in sorted(left, reverse=True):
        n = left[length]
        while n and (gap := min((g for g in groups if g >= length), default=None)) is not None:
            lengths, m = groups[gap].pop()
            most = min(gap // length, n)  # as many in one sequence as fit
            t = min(m, n // most)
            if m > t:
                groups[gap].append((lengths, m - t))
            if not groups[gap]:
                del groups[gap]
            groups.setdefault(gap - most * length, []).append((lengths + (length,) * most, t))
            n -= t * most
        fit = capacity // length
        for times, each in ((n // fit, fit), (1, n % fit)):
            if times and each:
                groups.setdefault(capacity - each * length, []).append(((length,) * each, times))
    return out + [x for g in sorted(groups) for x in groups[g]]


def _slots(patterns: list[tuple[tuple[int, ...], int]], histogram: dict[int, int], capacity: int):
    """For ordinals (lengths in turn, pieces of a length by rank): starts of slots, and of each its first sequence, pieces a sequence, length and offset."""
    base = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        base[length + 1] = n
    base = np.cumsum(base)
    taken, sequence, rows = base.copy(), 0, []
    for lengths, times in patterns:
        offset = 0
        for length, each in sorted(Counter(lengths).items(), reverse=True):
            rows.append((taken[length], sequence, each, length, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    slots = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return base, slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece with the sequence it goes to and its offset there, gapless from 0: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = table(pieces(docs, tokenizer, capacity, closing_id, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    base, slots = _slots(plan(histogram, capacity), histogram, capacity)
    buckets = max(LEAST_BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = cut.withColumn("rank", rank).join(ahead, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("ahead")).drop("bucket", "ahead")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinal = base[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            slot = slots[np.searchsorted(slots[:, 0], ordinal, "right") - 1] if len(slots) else slots
            k = ordinal - slot[:, 0]
            new = {"sequence_id": slot[:, 1] + k // slot[:, 2], "offset": slot[:, 4] + k % slot[:, 2] * slot[:, 3]}
            yield pa.RecordBatch.from_arrays([batch.column(c) if c in batch.schema.names else pa.array(new[c]) for c in names], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)
