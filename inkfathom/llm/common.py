"""What several operators share: tables that cut lineage, columns that cannot clash, and words of whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.tables import shared_dir, table

__all__ = ["documents", "gram_hashes", "id_and_text", "mixed", "shared_dir", "signed", "slices", "split_words", "table", "word_hashes", "words_column"]

#: White space that separates words: space and bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
_TO_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_TO_SPACE_LOWER = bytes.maketrans(b"\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator works on, so that no other column can clash with its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def words_column(text: Column) -> Column:
    """array<string> of the words of a text; empty for null or white space only."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about max_bytes of text, at least one row each, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, as (code of each word, first word of each text and the end, distinct words by code).

    Null counts as empty. With lower, A-Z become a-z and nothing else changes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.large_string())
    _, offsets, data = texts.buffers()
    raw = (data.to_pybytes() if data is not None else b"").translate(_TO_SPACE_LOWER if lower else _TO_SPACE)
    texts = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw))
    lists = pc.split_pattern(texts, " ")
    flat, ends = lists.values, np.asarray(lists.offsets)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[ends].astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n words from each position; shorter than h by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + h[i : i + len(out)]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
