"""Removal of repeated passages with compressed FM-indexes, one per shard of like content.

Every window of `WINDOW` words has a minimizer, the least hash of its `GRAM`-word runs; equal windows have equal ones.
Successive windows of a document with one minimizer are a region. A region whose minimizer nothing else has can hold no
repeat; the others are fetched, equal regions become one, and what is left is dealt by minimizer to shards. A shard is
an FM-index over the words of its regions: the words before the sorted suffixes in a wavelet matrix of bit vectors with
counts, and one byte of common prefix length a word; the suffixes themselves are dropped. The regions then stream through
it from their last word. Each backward search step takes one word more; where that leaves no occurrence but the region's
own, the match is cut back to its parent interval, as often as needed, so that every position gets its matching statistic:
how many words from there on occur elsewhere in the shard. Statistics of `WINDOW` words and more are reported, each with
the interval of its window; of the places reported for one interval the earliest stays, the others are repeats.
Minimizers with more than `HOT` different regions are taken apart into windows first, equal ones of which become one row,
so that no shard grows without bound; which way a minimizer goes makes no difference to the result.

Null and empty texts have no words; texts of fewer than `WINDOW` words stay; texts of any length are indexed whole. Rows
that repeat doc_id and text are one document; other rows that repeat a doc_id are told apart, and ordered, by a hash of
their text. A row without doc_id is neither earlier nor later than any other: it keeps its words and takes none from
others, whatever else the table holds. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, id_and_text, mixed, signed, slices, split_words, table, word_hashes

WINDOW, GRAM = 20, 6
#: Windows of a region at most; words of a shard, about; regions of a minimizer in shards, at most.
REGION, SHARD_WORDS, HOT = 64, 250_000, 400
#: Bytes of text that a Python worker takes at a time: its arrays are many times as large.
SLICE = 2 << 20


def _regions(ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimizer of each region in the words of several texts, and whether it may hold its minimizer twice."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = gram_hashes(h, GRAM)
    least, width = grams, 1
    want = WINDOW - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    whole = np.zeros(n + 1, np.int64)
    begin, stop = ends[:-1], np.maximum(ends[1:] - WINDOW + 1, ends[:-1])
    some = stop > begin
    np.add.at(whole, begin[some], 1)
    np.add.at(whole, stop[some], -1)
    inside = np.cumsum(whole[:-1]) > 0
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    fresh[begin[some]] = True
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= inside & (since % REGION == 0)
    first = np.flatnonzero(fresh)
    last = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]]))
    close = np.zeros(len(grams) + 1, np.int64)  # an equal run of words follows so near that one region can hold both
    for d in range(1, min(want + 1, len(grams))):
        close[1 : len(grams) - d + 1] |= grams[:-d] == grams[d:]
    close = np.cumsum(close)
    return first, last - first + 1, least[first], close[last + want] > close[first]


def candidates(rows: DataFrame) -> DataFrame:
    """mini, doc, start, windows of the regions whose minimizer occurs again."""
    schema = "mini long, salt long, doc long, start int, windows int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.uint64)  # minimizers that this task has given a marker of
        for batch in slices(batches, max_bytes=SLICE):
            codes, ends, distinct = split_words(batch.column("text"))
            first, windows, mini, periodic = _regions(ends, word_hashes(distinct)[codes])
            row = np.searchsorted(ends, first, "right") - 1
            doc = batch.column("doc").to_numpy()[row]
            # What repeats in this slice is known to repeat: it needs no counting, and one marker tells the other tasks.
            _, back, n = np.unique(mini, return_inverse=True, return_counts=True)
            if len(told):
                old = told[np.minimum(np.searchsorted(told, mini), len(told) - 1)] == mini
            else:
                old = np.zeros(len(mini), bool)
            known = (n[back] > 1) | periodic | old
            salt = np.where(known, np.maximum(np.arange(len(mini)), 1), 0)
            marks = np.unique(mini[known & ~old])
            told = np.union1d(told, marks)
            none = np.zeros(len(marks), np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([mini, marks]))),
                    pa.array(np.concatenate([salt, none]).astype(np.int64)),
                    pa.array(np.concatenate([doc, none]).astype(np.int64), mask=np.concatenate([np.zeros(len(mini), bool), np.ones(len(marks), bool)])),
                    pa.array(np.concatenate([first - ends[row], none]).astype(np.int32)),
                    pa.array(np.concatenate([windows, none]).astype(np.int32)),
                ],
                names=["mini", "salt", "doc", "start", "windows"],
            )

    found = rows.mapInArrow(find, schema)
    found = found.withColumn("again", F.expr("count(*) over (partition by mini, salt) + count_if(doc is null) over (partition by mini, salt)"))
    return found.where("doc is not null and (salt > 0 or again > 1)").select("mini", "doc", "start", "windows")


def _with_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """mini, content (hash of the words), doc, start, windows, words of candidate regions."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "mini")).alias("regions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE // 2):
            codes, ends, distinct = split_words(batch.column("text"))
            regions = batch.column("regions")
            flat = regions.flatten()
            per = np.diff(np.asarray(regions.offsets))
            start, windows = (flat.field(i).to_numpy() for i in (0, 1))
            at = np.repeat(ends[:-1], per) + start
            size = windows + WINDOW - 1
            upto = np.concatenate([[0], np.cumsum(size)])
            index = np.repeat(at - upto[:-1], size) + np.arange(upto[-1])
            words = codes[index]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), distinct.cast(pa.string()).take(pa.array(words))), " ")
            # Windows of one region can be equal only if the minimizer is there twice.
            grams = np.append(gram_hashes(word_hashes(distinct)[words], GRAM), np.zeros(GRAM - 1, np.uint64))
            hit = (grams == np.repeat(flat.field(2).to_numpy().view(np.uint64), size)) & (np.arange(upto[-1]) - np.repeat(upto[:-1], size) <= np.repeat(size, size) - GRAM)
            periodic = np.add.reduceat(hit.astype(np.int64), upto[:-1]) > 1
            yield pa.RecordBatch.from_arrays([flat.field(2), pa.array(np.repeat(batch.column("doc").to_numpy(), per)), flat.field(0), flat.field(1), pa.array(periodic), texts], names=["mini", "doc", "start", "windows", "periodic", "words"])

    joined = rows.join(per_doc, "doc").select("doc", "text", "regions")
    out = joined.mapInArrow(cut, "mini long, doc long, start int, windows int, periodic boolean, words string")
    return out.withColumn("content", F.xxhash64("words"))


class FMIndex:
    """An index of word codes (from 1; 0 parts regions), for patterns of at most `depth` words, 255 at most."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = self.n = len(codes)
        ranks, width = [codes.astype(np.int64)], 1
        order = np.argsort(ranks[0], kind="stable")
        while width < depth:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: n - width] = ranks[-1][width:] + 1
            key = ranks[-1] * (n + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            ranks.append(new)
            width *= 2
        self.common = self._common(ranks, order)
        self._edges: dict[int, np.ndarray] = {}
        symbols = int(codes.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=symbols))])  # first suffix by first word
        self._wavelet(codes[order - 1], symbols)

    @staticmethod
    def _common(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Words that each suffix and the one before it begin with alike, 255 at most; 0 at both ends."""
        n = len(order)
        one, two = order[:-1].copy(), order[1:].copy()
        size = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            there = np.flatnonzero((one < n) & (two < n))
            same = there[ranks[k][one[there]] == ranks[k][two[there]]]
            one[same] += 1 << k
            two[same] += 1 << k
            size[same] += 1 << k
        return np.concatenate([[0], np.minimum(size, 255), [0]]).astype(np.uint8)

    def edges(self, depth: int) -> np.ndarray:
        """Where suffixes begin with other words than the one before, in their first `depth`; and the end."""
        if depth not in self._edges:
            self._edges[depth] = np.flatnonzero(self.common < depth).astype(np.int32)
        return self._edges[depth]

    def _wavelet(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels, place = [], np.zeros(alphabet, np.int64)
        for level in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32)
            zeros = len(bits) - int(bits.sum())
            self.levels.append((level, packed, ones, zeros))
            place = self._down(place, np.arange(alphabet), *self.levels[-1])
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.place = place  # of each symbol in the last level

    @staticmethod
    def _down(at: np.ndarray, symbol: np.ndarray, level: int, packed: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        one = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where(symbol >> level & 1, zeros + one, at - one)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with a word more: one backward search step."""
        for level in self.levels:
            lo, hi = self._down(lo, symbol, *level), self._down(hi, symbol, *level)
        shift = self.before[symbol] - self.place[symbol]
        return lo + shift, hi + shift

    def cut(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the same `depth` words as those at `at`."""
        edges = self.edges(depth)
        k = np.searchsorted(edges, at, "right")
        return edges[k - 1].astype(np.int64), edges[k].astype(np.int64)

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least wider intervals, and how many words their suffixes have in common."""
        depth = np.maximum(self.common[lo], self.common[hi]).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for d in np.unique(depth[depth >= WINDOW - 1]):
            own = depth == d
            lo[own], hi[own] = self.cut(lo[own], int(d))
        return lo, hi, depth


def matching_statistics(index: FMIndex, text: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of text, how many words from there on occur elsewhere in the index (0 below WINDOW), and where the interval of its window begins.

    The regions end at the places `last` and have `size` words, the longest first; all take a step at once.
    """
    statistic, interval = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    lo, hi, got = np.zeros(len(size), np.int64), np.full(len(size), index.n), np.zeros(len(size), np.int64)
    short = WINDOW - 1  # so many words are kept whether or not they occur elsewhere
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, "left"))  # regions of more than t words
        lo, hi, got = lo[:live], hi[:live], got[:live]
        at = last[:live] - t
        new_lo, new_hi = index.extend(lo, hi, text[at])
        alone = np.flatnonzero((got >= short) & (new_hi - new_lo < 2))
        while len(alone):
            up_lo, up_hi, depth = index.parent(lo[alone], hi[alone])
            up = (got[alone] > short) & (depth >= short)
            alone, up_lo, up_hi = alone[up], up_lo[up], up_hi[up]
            lo[alone], hi[alone], got[alone] = up_lo, up_hi, depth[up]
            new_lo[alone], new_hi[alone] = index.extend(up_lo, up_hi, text[at[alone]])
            alone = alone[new_hi[alone] - new_lo[alone] < 2]
        lo, hi, got = new_lo, new_hi, got + 1
        lost = np.flatnonzero((got > short) & (hi - lo < 2))
        lo[lost], hi[lost] = index.cut(lo[lost], short)
        got[lost] = short
        found = np.flatnonzero(got > short)
        statistic[at[found]] = got[found]
        interval[at[found]] = index.cut(lo[found], WINDOW)[0]
    return statistic, interval


def repeats(words: pa.Array, order: np.ndarray) -> list[np.ndarray]:
    """For each region, which of its windows occurs in the shard at a smaller place; order is the place of each region's first window."""
    codes, ends, _ = split_words(words)
    n_regions, size = len(ends) - 1, np.diff(ends)
    shift = np.arange(n_regions)
    text = np.zeros(len(codes) + n_regions, np.int64)
    begin = ends[:-1] + shift
    text[np.arange(len(codes)) + np.repeat(shift, size)] = codes + 1
    place = np.repeat(order - begin, size + 1) + np.arange(len(text))
    by_size = np.argsort(-size, kind="stable")
    index = FMIndex(text, int(size.max(initial=1)))
    statistic, interval = matching_statistics(index, text, (begin + size - 1)[by_size], size[by_size])
    at = np.flatnonzero(statistic)
    later = np.zeros(len(text), bool)
    if len(at):  # of the places reported for an interval, all but the earliest
        at = at[np.lexsort((place[at], interval[at]))]
        later[at[1:]] = interval[at[1:]] == interval[at[:-1]]
    return [later[b : b + max(0, s - WINDOW + 1)] for b, s in zip(begin, size)]


def _in_shards(regions: DataFrame) -> DataFrame:
    """doc, start, windows of the repeats among distinct regions (mini, doc, start, windows, words), partitioned and sorted by mini."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, start = batch.column("doc").to_numpy(), batch.column("start").to_numpy()
            _, number = np.unique(doc, return_inverse=True)
            rows = []
            for d, s, hit in zip(doc, start, repeats(batch.column("words"), number.astype(np.int64) * (1 << 32) + start)):
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    rows += [(d, s + a, b - a) for a, b in zip(edge[::2], edge[1::2])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "windows"])

        def ready(closing: bool) -> Iterator[pa.RecordBatch]:
            """Shards of whole minimizers from what is held."""
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            mini = whole.column("mini").to_numpy()
            words = np.cumsum(whole.column("windows").to_numpy().astype(np.int64) + WINDOW - 1)
            edges = np.append(np.flatnonzero(mini[1:] != mini[:-1]) + 1, len(mini))
            at = 0
            while at < len(mini):
                done = words[at - 1] if at else 0
                k = int(np.searchsorted(words[edges - 1], done + SHARD_WORDS))
                end = int(edges[min(k, len(edges) - 1)])
                if end == len(mini) and not closing:
                    held.append(whole.slice(at))
                    return
                yield shard(whole.slice(at, end - at))
                at = end

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) * 27 > 2 * SHARD_WORDS:
                    yield from ready(False)
        yield from ready(True)

    return regions.mapInArrow(search, "doc long, start int, windows int")


def _by_window(regions: DataFrame) -> DataFrame:
    """The same, for minimizers with very many regions: each window by its hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", SLICE // 2):
            codes, ends, distinct = split_words(batch.column("words"))
            h = word_hashes(distinct)[codes]
            n = np.maximum(np.diff(ends) - WINDOW + 1, 0)
            upto = np.concatenate([[0], np.cumsum(n)])
            inner = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
            at = np.repeat(ends[:-1], n) + inner
            one, two = gram_hashes(h, WINDOW)[at], gram_hashes(mixed(h), WINDOW)[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two)), pa.array(np.repeat(batch.column("doc").to_numpy(), n)), pa.array((np.repeat(batch.column("start").to_numpy(), n) + inner).astype(np.int32))], names=["one", "two", "doc", "start"])

    windows = table(regions.mapInArrow(cut, "one long, two long, doc long, start int"), "hot-windows")
    least = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = table(least, "hot-least")  # so that both sides of the join are exchanged, and a window that is everywhere can be split
    return windows.join(least, ["one", "two"]).where(F.struct("doc", "start") != F.col("least")).select("doc", "start", F.lit(1).alias("windows"))


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """doc, start, windows: runs of windows of rows (doc, text) that occur earlier too, by doc and then start."""
    wanted = table(candidates(rows), "regions")
    regions = table(_with_words(rows, wanted), "region-words", "zstd")
    distinct = regions.groupBy("mini", "content").agg(F.min(F.struct("doc", "start", "windows", "periodic", "words")).alias("one"), F.count("*").alias("copies"))
    distinct = table(distinct.select("mini", "content", "copies", "one.*"), "distinct-regions", "zstd")
    first = distinct.where("copies > 1").select("mini", "content", F.struct("doc", "start").alias("first"))
    copies = regions.select("mini", "content", "doc", "start", "windows").join(first, ["mini", "content"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "windows")
    per_mini = distinct.groupBy("mini").agg(F.count("*").alias("n"), F.max("periodic").alias("any")).where("n > 1 or any")
    per_mini = table(per_mini, "minimizers")  # as above
    several = distinct.select("mini", "doc", "start", "windows", "words").join(per_mini, "mini")
    shards = several.where(F.col("n") <= HOT).drop("n", "any").repartition("mini").sortWithinPartitions("mini")
    found = _in_shards(shards).union(_by_window(several.where(F.col("n") > HOT).drop("n", "any"))).union(copies)
    return table(found, "repeats")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed and removed (start and number of words of each removed interval)."""
    rows = id_and_text(docs)
    twice = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if twice:  # rows of one doc_id are told apart
        rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
        ids = table(rows.where("doc_id is not null").select("doc_id", "mark").distinct().orderBy("doc_id", "mark").withColumn("doc", F.monotonically_increasing_id()), "ids")
        rows = table(rows.join(ids, (rows["doc_id"] == ids["doc_id"]) & (rows["mark"] == ids["mark"]), "left").select(rows["doc_id"], "doc", "text"), "rows")
        unique = rows.where("doc is not null").dropDuplicates(["doc"])
    else:
        rows = unique = rows.withColumn("doc", F.col("doc_id"))
    found = repeated_intervals(unique.select("doc", "text").where("doc is not null"))
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    joined = rows.join(per_doc, "doc", "left").select("doc_id", "text", "gone")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE):
            codes, ends, distinct = split_words(batch.column("text"))
            out, n_words, n_removed, removed = [], [], [], []
            gone = batch.column("gone").to_pylist()
            words = None
            for k in range(len(ends) - 1):
                n = int(ends[k + 1] - ends[k])
                cover = np.zeros(n + 1, np.int32)
                for g in gone[k] or ():
                    cover[g["start"]] += 1
                    cover[min(n, g["start"] + g["windows"] + WINDOW - 1)] -= 1
                lost = np.cumsum(cover[:-1]) > 0
                if words is None:
                    words = np.array(distinct.to_pylist(), object)
                out.append(" ".join(words[codes[ends[k] : ends[k + 1]][~lost]]) if n else "")
                n_words.append(n)
                n_removed.append(int(lost.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                removed.append([{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in out]), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))],
                names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256", "removed"],
            )

    return joined.mapInArrow(keep, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,words:int>>")
