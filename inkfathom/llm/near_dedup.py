"""Near-duplicate components from bottom-k sketches of one hash function, confirmed by exact Jaccard similarity.

A document's set is its distinct shingles of `WORDS` words, A-Z lower-cased; a shorter one has its whole sequence as one
shingle. Documents with equal sets are one class from the start. A class keeps the `RETAINED` smallest hashes of its set
(its sketch). Inverted lists hold the classes with two successive retained values among the `keyed()` smallest in common;
for a pair at the threshold that none of these agree has a chance of at most `MISSED`. Lists of at most `SMALL`
classes give all their pairs; of a longer list, each class is paired with the most central one. The union sketch
estimates each pair's similarity, and what may reach the threshold is decided on the full sets. Whatever in a longer
list is not in its centre's component by then is compared with the whole list, in blocks, on full sets; only the links
that join components leave a block. So hot lists lose no link and never make all their pairs as rows.

Null, empty and white-space texts have an empty set, no links and their own doc_id as component. Rows that repeat a text
are one class, of any size; a text of any length has its whole set. Rows are told apart by id and a hash of their text, so
rows that repeat an id with other texts each have their own links. A row without id links as others do, but names no
component: component_id is the least id that is there, null if none is. `first` marks one row of each component (but for
rows that repeat id and text): that with the least id, ids that are null last, ties by the hash. Components are found by
alternating star contraction over tables; nothing is collected. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.operators.graph import components

from .common import gram_hashes, id_and_text, mixed, slices, split_words, table, word_hashes

WORDS, PER_CENT = 5, 85
RETAINED, SMALL = 128, 24
MISSED = 2.5e-7
#: Estimates so many standard deviations of a sketch of RETAINED values below the threshold count as possible.
DEVIATIONS = 4.5
BLOCK, CHUNK = 512, 1024
_SALT = np.uint64(0xD6E8FEB86659FD93)


@cache
def keyed(per_cent: int) -> int:
    """How many of the smallest hashes two sets at the threshold need, to have two successive ones in common but for a chance of MISSED."""

    def missed(k: int) -> float:
        share, lost = per_cent / 100, 0.0
        now = {(0, 0, False): 1.0}  # values so far of one and of the other, whether both had the last one
        while now:
            following: dict[tuple[int, int, bool], float] = {}
            for (a, b, last), p in now.items():
                for q, x, y in ((share, a + 1, b + 1), ((1 - share) / 2, a + 1, b), ((1 - share) / 2, a, b + 1)):
                    both = x > a and y > b
                    if max(x, y) > k:
                        lost += p * q
                    elif not (both and last):
                        following[x, y, both] = following.get((x, y, both), 0.0) + p * q
            now = following
        return lost

    return next((k for k in range(2, RETAINED) if missed(k) <= MISSED), RETAINED)


def slack(per_cent: int) -> float:
    return DEVIATIONS * math.sqrt(per_cent / 100 * (1 - per_cent / 100) / RETAINED)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, ends, distinct = split_words(texts, lower=True)
    h = word_hashes(distinct)[codes]
    grams = gram_hashes(h, WORDS)
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], int(b - a)) ^ mixed(_SALT + np.arange(b - a, b - a + 1, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark: with doc_id, what tells rows apart."""
    return id_and_text(docs).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def signatures(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, digest (of the set), sketch, keys of every row."""
    n_keyed = keyed(per_cent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            sketch = [s[:RETAINED] for s in sets]
            keys = [mixed(s[: n_keyed - 1][: max(len(s) - 1, 0)] * np.uint64(31) + s[1:n_keyed]).view(np.int64) if len(s) > 1 else np.zeros(0, np.int64) for s in sketch]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "sketch", "keys"],
            )

    return marked(docs).mapInArrow(sign, "doc_id long, mark long, n_shingles long, digest binary, sketch binary, keys array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two sketches: the share, among the smallest values of their union, of those in both."""
    union = np.union1d(a, b)
    if len(a) >= RETAINED or len(b) >= RETAINED:
        union = union[: min(RETAINED, len(union))]
    last = union[-1]
    both = np.intersect1d(a[a <= last], b[b <= last], assume_unique=True)
    return len(both) / len(union)


def similar(a: np.ndarray, b: np.ndarray, per_cent: int = PER_CENT) -> bool:
    """Whether two sets reach the threshold, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _estimated(pairs: DataFrame, per_cent: int) -> DataFrame:
    least = per_cent / 100 - slack(per_cent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b")]
            keep = pa.array([estimate(x, y) >= least for x, y in zip(*sides)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.mapInArrow(judge, "a binary, b binary")


def _confirmed(pairs: DataFrame, per_cent: int) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            keep = [similar(x, y, per_cent) for x, y in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(judge, "a binary, b binary")


def _blocks(rows: DataFrame, per_cent: int) -> DataFrame:
    """Links between components from rows (task, side, digest, label, text), sorted: side 0 is a block, side 1 is compared with it."""

    def counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        values = np.concatenate([*left, *right])
        own, number = np.unique(values, return_inverse=True)
        n = np.bincount(number, minlength=len(own))
        new = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[number]  # values that only one set has count for nothing
        row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
        row, new = row[new >= 0], new[new >= 0]
        out = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(new, kind="stable")
        row, new = row[order], new[order]
        width = 4096
        for at in range(0, int(new[-1]) + 1 if len(new) else 0, width):
            a, b = np.searchsorted(new, [at, at + width])
            m = np.zeros((len(left) + len(right), width), np.float32)
            m[row[a:b], new[a:b] - at] = 1
            out += m[: len(left)] @ m[len(left) :].T
        return out.astype(np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, root = None, [], {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root.setdefault(root[x], root[x])
            return x

        for batch in slices(batches, max_bytes=1 << 20):
            sets = shingle_sets(batch.column("text"))
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("task", "side", "digest", "label")), sets))
            found: list[tuple[bytes, bytes]] = []
            at = 0
            while at < len(rows):
                if rows[at][0] != task:
                    task, block, root = rows[at][0], [], {}
                end = at
                while end < len(rows) and rows[end][0] == task:
                    end += 1
                fresh = rows[at:end]
                block += [r for r in fresh if r[1] == 0]
                left, right = [r[4] for r in block], [r[4] for r in fresh]
                if left:
                    both = counts(left, right)
                    size = np.array([[len(s)] for s in left]) + np.array([len(s) for s in right])
                    for i, j in zip(*np.nonzero(100 * both >= per_cent * (size - both))):
                        x, y = find(block[i][3]), find(fresh[j][3])
                        if x != y:
                            root[x] = y
                            found.append((block[i][2], fresh[j][2]))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*found) if found else ([], []))], names=["a", "b"])

    return rows.mapInArrow(compare, "a binary, b binary")


def dedup(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size (rows with the same set), mark and first of every row; per_cent is the similarity of near-duplicates."""
    rows = marked(docs)
    signs = table(signatures(docs, per_cent), "signatures")
    some = signs.where("n_shingles > 0")
    members = some.select("digest", "n_shingles", F.explode("keys").alias("key")).groupBy("key", "digest").agg(F.max("n_shingles").alias("n"))
    lists = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = table(members.join(lists, "key"), "members")

    # Pairs: all of small lists, and each with the most central class of long ones.
    other = members.where(F.col("m") <= SMALL).select("key", F.col("digest").alias("b"), F.col("n").alias("n_b"))
    close = (100 * F.least("n", "n_b") >= per_cent * F.greatest("n", "n_b")) & (F.col("digest") < F.col("b"))
    pairs = members.where(F.col("m") <= SMALL).join(other, "key").where(close).select(F.col("digest").alias("a"), "b")
    hot = members.where(F.col("m") > SMALL)
    weight = hot.groupBy("digest").agg(F.sum("m").alias("weight"))
    centres = hot.join(weight, "digest").groupBy("key").agg(F.max(F.struct("weight", "digest", "n")).alias("c")).select("key", F.col("c.digest").alias("centre"), F.col("c.n").alias("n_b"))
    hot = table(hot.join(table(centres, "centres"), "key"), "hot-lists")  # a table, so that both sides are exchanged and a long list can be split
    star = hot.where((F.col("digest") != F.col("centre")) & (100 * F.least("n", "n_b") >= per_cent * F.greatest("n", "n_b")))
    star = star.select(F.least("digest", "centre").alias("a"), F.greatest("digest", "centre").alias("b"))
    pairs = pairs.union(star).distinct()

    wanted = members.select("digest").distinct()
    sketches = table(some.groupBy("digest").agg(_least().alias("one"), F.first("sketch").alias("sketch")).join(wanted, "digest").select("digest", "one.doc_id", "one.mark", "sketch"), "sketches")
    side = lambda df, s, what: df.select(F.col("digest").alias(s), F.col(what).alias(f"{what}_{s}"))
    likely = table(_estimated(pairs.join(side(sketches, "a", "sketch"), "a").join(side(sketches, "b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b"), per_cent), "likely")

    needed = likely.select(F.col("a").alias("digest")).union(likely.select("b")).union(hot.select("digest")).distinct()
    named = sketches.select("digest", F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark")).join(needed, "digest")
    texts = named.join(rows, F.col("its_id").eqNullSafe(F.col("doc_id")) & (F.col("its_mark") == F.col("mark")))
    texts = table(_one_text(texts), "texts")
    links = table(_confirmed(likely.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "text_a", "text_b"), per_cent), "links")

    # Long lists that are not one component yet: what is outside the centre's, block by block, against all.
    labels = table(components(links).withColumnRenamed("root", "label"), "labels")
    named = hot.select("key", "digest", "centre").join(labels, hot["digest"] == labels["node"], "left").select("key", "digest", "centre", F.coalesce("label", "digest").alias("label"))
    centre = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    named = table(named.join(centre, "centre", "left").select("key", "digest", "label", (F.col("label") != F.coalesce("centre_label", "centre")).alias("out")), "named")
    open_lists = named.groupBy("key").agg(F.count("*").alias("m"), F.count_if("out").alias("out_m")).where("out_m > 0")
    work = named.join(open_lists, "key")
    blocks, chunks = F.ceil(F.col("out_m") / BLOCK).cast("int"), F.ceil(F.col("m") / CHUNK).cast("int")
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    work = work.withColumns({"blocks": blocks, "chunks": chunks}).withColumns({"block": (place % F.col("blocks")).cast("int"), "chunk": (F.shiftright(place, 7) % F.col("chunks")).cast("int")})
    task = lambda b, c: F.struct(F.col("key").alias("key"), b.alias("block"), c.alias("chunk"))
    held = F.when(F.col("out"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(task(F.col("block"), c).alias("task"), F.lit(0).alias("side"))))
    seen = F.transform(F.sequence(F.lit(0), F.when(F.col("out"), F.col("block")).otherwise(F.col("blocks")) - 1), lambda b: F.struct(task(b, F.col("chunk")).alias("task"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<task:struct<key:bigint,block:int,chunk:int>,side:int>>")
    seen = F.when(F.col("out") & (F.col("block") == 0), none).otherwise(seen)
    dealt = work.select("digest", "label", F.explode(F.concat(F.coalesce(held, none), seen)).alias("t")).select("digest", "label", F.xxhash64("t.task").alias("task"), "t.side")
    dealt = dealt.join(texts, "digest").select("task", "side", "digest", "label", "text").repartition("task").sortWithinPartitions("task", "side")
    more = table(_blocks(dealt, per_cent), "more-links")

    every = components(links.union(more)).withColumnRenamed("root", "label")
    classes = some.groupBy("digest").agg(F.count("*").alias("class_size"), _least().alias("one")).join(every, F.col("digest") == every["node"], "left")
    classes = classes.select("digest", "class_size", "one", F.coalesce("label", "digest").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("one").alias("least"))
    out = table(classes.join(smallest, "label").select("digest", "class_size", "least"), "classes")
    out = signs.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(out, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")))
    first = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "mark", first.alias("first"))


def first_rows(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """docs with one row of each component; rows with an empty set all stay. Columns are as they were."""
    firsts = table(dedup(docs, per_cent).where("first").groupBy("doc_id", "mark").agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows")), "first-rows")
    whole = docs.select(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_mark"), F.struct(*[docs[c] for c in docs.columns]).alias("_whole"))

    def of(wanted: DataFrame) -> DataFrame:
        return whole.join(wanted, whole["_id"].eqNullSafe(wanted["doc_id"]) & (whole["_mark"] == wanted["mark"]), "left_semi")

    repeated = (F.col("n") > 0) & (F.col("rows") > 1)
    out = of(firsts.where(~repeated))
    if not firsts.where(repeated).isEmpty():
        out = out.union(of(firsts.where(repeated)).dropDuplicates(["_id", "_mark"]))
    return out.select("_whole.*")


def _least() -> Column:
    """Of several rows the one with the least id, ids that are null last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))


def _one_text(texts: DataFrame) -> DataFrame:
    """One text of each digest; texts whose marks agree by chance are told apart by their sets."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = [d == xxhash.xxh128_digest(s.tobytes()) for d, s in zip(batch.column("digest").to_pylist(), shingle_sets(batch.column("text")))]
            yield batch.select(["digest", "text"]).filter(pa.array(same, pa.bool_()))

    return texts.select("digest", "text").mapInArrow(own, "digest binary, text string").dropDuplicates(["digest"])
