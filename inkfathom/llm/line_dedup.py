"""Reversible line dedup: cuckoo filters by shard, backed by exact reference tables.

A line's key is the line without white space at both ends, A-Z lower-cased; keys shorter than `least` code points are
never dropped. `refs` holds one row for each key and document. Every reference asks its shard's cuckoo filter first: a
key that the filter has not seen is new, goes into it, and is looked up nowhere. Only keys that the filter may have are
looked up: in the exact keys of the shard while an index is built, in the exact table when documents are added. Those
that are there are `shared`, and only references of shared keys are ever grouped: of a key that two documents or more
hold, the smallest doc_id keeps its lines. A key that the filter wrongly took for an old one is inserted as well, so that
deleting another never hides it. Deleting documents deletes their references, and keys whose last reference goes from the
filters, so the next document gets its lines back: insert and delete in any order give what the remaining documents would
give alone. Once a shard would hold twice its keys, there are more shards.

Null text counts as empty, which is one empty line; texts of any length are split whole. Rows without a doc_id keep all
lines. Rows that repeat a doc_id count as one document, so ties between documents cannot be. An empty table gives an empty
index and result; other columns are kept by `apply` and cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, id_and_text, table

LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
#: Keys that one shard is meant to hold.
SHARD_KEYS = 250_000
_SEED = 42  # of Spark's xxhash64
_SALT = 7
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(line: str) -> tuple[int, int] | None:
    """What _key and the two hash columns give, for one line in Python."""
    key = line.strip(BLANK).translate(_ASCII_LOWER)
    if len(key) < LEAST:
        return None
    raw = key.encode()
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    first = xxhash.xxh64_intdigest(struct.pack("<q", _SALT), _SEED)
    return sign(xxhash.xxh64_intdigest(raw, _SEED)), sign(xxhash.xxh64_intdigest(raw, first))


def references(docs: DataFrame) -> DataFrame:
    """key_a, key_b (128 bits of hash), doc_id: each key of each document once."""
    lines = id_and_text(docs).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    keys = lines.select("doc_id", _key(F.col("line")).alias("key")).where(F.length("key") >= LEAST)
    return keys.groupBy(F.xxhash64("key").alias("key_a"), F.xxhash64(F.lit(_SALT).cast("long"), "key").alias("key_b"), "doc_id").agg(F.count("*").alias("n_lines"))


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key. Full filters get a further segment; keys inserted once can be deleted."""

    SLOTS, LOAD, KICKS = 4, 0.85, 200

    def __init__(self, segments: list[np.ndarray] | None = None):
        self.segments = segments or []

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.int64(buckets - 1)
        mark = ((b >> np.int64(20)) & np.int64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (a >> np.int64(8)) & mask
        return mark, one, CuckooFilter._other(one, mark, mask)

    @staticmethod
    def _other(bucket, mark, mask):
        return (bucket ^ (np.asarray(mark, np.int64) * np.int64(0x5BD1E995))) & mask

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), bool)
        for seg in self.segments:
            mark, one, two = self._places(a, b, len(seg))
            found |= (seg[one] == mark[:, None]).any(1) | (seg[two] == mark[:, None]).any(1)
        return found

    def insert(self, a: np.ndarray, b: np.ndarray) -> None:
        """Inserts distinct keys that are not there yet."""
        while len(a):
            seg = self.segments[-1] if self.segments else None
            room = int(self.LOAD * seg.size) - int((seg != 0).sum()) if seg is not None else 0
            if room < max(1, len(a) // 2):
                buckets = 1 << max(4, int(np.ceil(np.log2(len(a) / self.SLOTS / self.LOAD))))
                seg = np.zeros((buckets, self.SLOTS), np.uint16)
                self.segments.append(seg)
                room = int(self.LOAD * seg.size)
            left = self._fill(seg, a[:room], b[:room])
            a, b = np.concatenate([a[:room][left], a[room:]]), np.concatenate([b[:room][left], b[room:]])
            if left.any():  # a full neighbourhood: what is left goes to a segment of its own
                self.segments.append(np.zeros((1 << max(4, int(left.sum()).bit_length()), self.SLOTS), np.uint16))

    def _fill(self, seg: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(a, b, len(seg))
        todo = np.arange(len(a))
        for side in [one, two] * self.SLOTS:
            if not len(todo):
                break
            bucket, at = np.unique(side[todo], return_index=True)  # one key a bucket and round
            free = seg[bucket] == 0
            fits = free.any(1)
            slot = free.argmax(1)
            seg[bucket[fits], slot[fits]] = mark[todo[at[fits]]]
            todo = np.delete(todo, at[fits])
        left = np.zeros(len(a), bool)
        rng, mask = np.random.default_rng(len(seg)), np.int64(len(seg) - 1)
        for k in todo:
            m, bucket, trail = mark[k], int(one[k]), []
            for _ in range(self.KICKS):
                free = np.flatnonzero(seg[bucket] == 0)
                if len(free):
                    seg[bucket, free[0]] = m
                    break
                s = int(rng.integers(self.SLOTS))
                trail.append((bucket, s, seg[bucket, s]))
                m, seg[bucket, s] = seg[bucket, s], m
                bucket = int(self._other(bucket, m, mask))
            else:
                for bucket, s, was in reversed(trail):
                    seg[bucket, s] = was
                left[k] = True
        return left

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """Deletes keys that were inserted; the exact table says which."""
        for k in range(len(a)):
            for seg in self.segments:
                mark, one, two = self._places(a[k : k + 1], b[k : k + 1], len(seg))
                hit = [(p, s) for p in (int(one[0]), int(two[0])) for s in np.flatnonzero(seg[p] == mark[0])]
                if hit:
                    seg[hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return struct.pack("<i", len(self.segments)) + b"".join(struct.pack("<i", len(s)) + s.tobytes() for s in self.segments)

    @classmethod
    def from_bytes(cls, raw: bytes | None) -> CuckooFilter:
        segments, at = [], 4
        for _ in range(struct.unpack_from("<i", raw)[0] if raw else 0):
            n = struct.unpack_from("<i", raw, at)[0]
            segments.append(np.frombuffer(raw, np.uint16, n * cls.SLOTS, at + 4).reshape(n, cls.SLOTS).copy())
            at += 4 + 2 * n * cls.SLOTS
        return cls(segments)


class Shard:
    """The keys of a shard while its filter is built: the filter first, and exact keys behind it for what it may have."""

    def __init__(self):
        self.filter, self.held, self.fresh, self.looked_up = CuckooFilter(), np.zeros(0, _KEY), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes distinct keys; which of them were there already."""
        maybe = self.filter.contains(a, b)
        known = np.zeros(len(a), bool)
        if maybe.any():
            self.looked_up += int(maybe.sum())
            known[maybe] = self._has(_keys(a[maybe], b[maybe]))
        new = ~known
        self.filter.insert(a[new], b[new])
        self.fresh.append(_keys(a[new], b[new]))
        return known

    def _has(self, keys: np.ndarray) -> np.ndarray:
        if self.fresh:
            self.held, self.fresh = np.sort(np.concatenate([self.held, *self.fresh])), []
        at = np.minimum(np.searchsorted(self.held, keys), max(len(self.held) - 1, 0))
        return self.held[at] == keys if len(self.held) else np.zeros(len(keys), bool)


_KEY = np.dtype([("a", np.int64), ("b", np.int64)])


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _KEY)
    out["a"], out["b"] = a, b
    return out


@dataclass
class LineIndex:
    """filters: shard, filter. refs: key_a, key_b, doc_id, n_lines. shared: key_a, key_b of the keys that came again. All are tables in the shared folder."""

    refs: DataFrame
    filters: DataFrame
    shared: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The index of documents, from nothing."""
        refs = table(references(docs), "line-refs")
        return cls._over(refs, max(16, -(-refs.count() // shard_keys)))

    @classmethod
    def _over(cls, refs: DataFrame, shards: int) -> LineIndex:
        """Filters and shared keys of references, in one pass by shard. A batch of references gives each key once, so a key that all documents hold gives few rows."""

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys, n = np.unique(_keys(batch.column("key_a").to_numpy(), batch.column("key_b").to_numpy()), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((keys["a"] % shards).astype(np.int32)), pa.array(keys["a"]), pa.array(keys["b"]), pa.array(n.astype(np.int32))], names=["shard", "key_a", "key_b", "n"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, own = None, Shard()

            def row(found: np.ndarray, raw: bytes | None) -> pa.RecordBatch:
                k = len(found) if raw is None else 1
                return pa.RecordBatch.from_arrays([pa.array([number] * k, pa.int32()), pa.array(found["a"] if raw is None else [0]), pa.array(found["b"] if raw is None else [0]), pa.array([raw] * k, pa.binary())], names=["shard", "key_a", "key_b", "filter"])

            for batch in batches:
                shard = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for at, end in zip(cuts, cuts[1:]):
                    if at == end:
                        continue
                    if shard[at] != number:
                        if number is not None:
                            yield row(np.zeros(0, _KEY), own.filter.to_bytes())
                        number, own = int(shard[at]), Shard()
                    a, b, n = (batch.column(c).to_numpy()[at:end] for c in ("key_a", "key_b", "n"))
                    keys, first, back = np.unique(_keys(a, b), return_index=True, return_inverse=True)
                    again = own.add(keys["a"], keys["b"]) | (np.bincount(back, n, len(keys)) > 1)
                    if again.any():
                        yield row(keys[again], None)
            if number is not None:
                yield row(np.zeros(0, _KEY), own.filter.to_bytes())

        dealt = refs.select("key_a", "key_b").mapInArrow(once, "shard int, key_a long, key_b long, n int").repartition("shard").sortWithinPartitions("shard")
        out = table(dealt.mapInArrow(fill, "shard int, key_a long, key_b long, filter binary"), "line-filters")
        return cls(refs, out.where(F.col("filter").isNotNull()).select("shard", "filter"), out.where(F.col("filter").isNull()).select("key_a", "key_b").distinct(), shards)

    def _shard(self) -> Column:
        return F.pmod("key_a", F.lit(self.shards)).cast("int").alias("shard")

    def _changed(self, keys: DataFrame, how: str) -> DataFrame:
        """The filters after insertion or deletion of distinct keys."""

        def step(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old["filter"].iloc[0] if len(old) else None)
            getattr(f, how)(new["key_a"].to_numpy(np.int64), new["key_b"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [int((old if len(old) else new)["shard"].iloc[0])], "filter": [f.to_bytes()]})

        return table(self.filters.groupBy("shard").cogroup(keys.withColumn("shard", self._shard()).groupBy("shard")).applyInPandas(step, "shard int, filter binary"), "line-filters")

    def maybe_held(self, keys: DataFrame) -> DataFrame:
        """Those of distinct keys that their filter may have: all that need an exact look."""

        def ask(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old["filter"].iloc[0] if len(old) else None)
            return new[["key_a", "key_b"]][f.contains(new["key_a"].to_numpy(np.int64), new["key_b"].to_numpy(np.int64))]

        return self.filters.groupBy("shard").cogroup(keys.withColumn("shard", self._shard()).groupBy("shard")).applyInPandas(ask, "key_a long, key_b long")

    def insert(self, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """Adds documents; those whose references are there already change nothing."""
        key = ["key_a", "key_b"]
        fresh = table(references(docs), "line-refs")
        own = fresh.groupBy(*key).agg(F.count("*").alias("n"))
        maybe = table(self.maybe_held(own.select(*key)), "line-maybe")
        known = table(self.refs.join(maybe, key, "left_semi"), "line-known")  # the exact look, for these keys alone
        old = known.select(*key).distinct()
        fresh = table(fresh.join(known.select(*key, "doc_id"), [*key, "doc_id"], "left_anti"), "line-refs")
        filters = self._changed(own.select(*key).join(old, key, "left_anti"), "insert")  # new ones, and those that the filter was wrong about
        again = fresh.select(*key).distinct().join(old, key, "left_semi").union(own.where("n > 1").select(*key))
        shared = table(self.shared.union(again).distinct(), "line-shared")
        refs = table(self.refs.unionByName(fresh), "line-refs")
        n = refs.count()
        return self._over(refs, -(-n // shard_keys)) if n > 2 * shard_keys * self.shards else LineIndex(refs, filters, shared, self.shards)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out again."""
        key = ["key_a", "key_b"]
        gone = table(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "line-gone")
        stays = table(self.refs.join(gone, "doc_id", "left_anti").select(*key, "doc_id", "n_lines"), "line-refs")
        touched = table(self.refs.join(gone, "doc_id", "left_semi").select(*key).distinct(), "line-touched")
        lost = table(touched.join(stays.select(*key), key, "left_anti"), "line-lost")
        return LineIndex(stays, self._changed(lost, "delete"), table(self.shared.join(lost, key, "left_anti"), "line-shared"), self.shards)

    def dropped(self) -> DataFrame:
        """doc_id, key_a, key_b of the lines that documents lose to a smaller doc_id: of shared keys only, the exact owner of each."""
        key = ["key_a", "key_b"]
        shared = table(self.shared, "line-shared")  # both sides of the joins are exchanged then, and a key that many documents hold can be split
        some = table(self.refs.join(shared, key, "left_semi").select("doc_id", *key), "line-some")
        owners = table(some.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "line-owners")
        return some.join(owners, key).where("owner < doc_id").select("doc_id", *key)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with the kept text in text_col, and n_lines, n_dropped as new columns (replacing columns of that name)."""
        lost = self.dropped().groupBy(F.col("doc_id").alias("_lost_id")).agg(F.collect_list(F.struct("key_a", "key_b")).alias("_lost"))
        rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_lost_id", "_lost")]
        joined = docs.select(*rest).join(lost, docs[id_col].cast("long") == lost["_lost_id"], "left").drop("_lost_id")
        fields = [f for f in docs.select(*rest).schema.fields]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long"

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(batch.column(text_col).to_pylist(), batch.column("_lost").to_pylist()):
                    text = text or ""
                    n_lines.append(text.count("\n") + 1)
                    if keys:
                        gone = {(k["key_a"], k["key_b"]) for k in keys}
                        lines = text.split("\n")
                        stay = [x for x in lines if _hashes(x) not in gone]
                        n_dropped.append(len(lines) - len(stay))
                        text = "\n".join(stay)
                    else:
                        n_dropped.append(0)
                    texts.append(text)
                columns = [pa.array(texts, batch.column(text_col).type) if c == text_col else batch.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*rest, "n_lines", "n_dropped"])

        return joined.mapInArrow(keep, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines that a smaller doc_id holds, with n_lines and n_dropped."""
    return LineIndex.build(docs).apply(docs)
