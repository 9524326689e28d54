"""Token counts of texts under a unigram vocabulary, by dynamic programming shared over a trie of distinct pre-tokens.

A batch's distinct pre-tokens go into a trie. Level by level, each node gets the best score of a segmentation of its
prefix into pieces, and that segmentation's number of tokens, from its ancestors within the longest piece; so a prefix
that many pre-tokens share is scored once. The counts at terminal nodes are kept, and a text's count is their sum.

Piece scores are those of the model file if it is a unigram model; of a BPE model they are ranks, from which a Zipf law
gives log probabilities: -log(rank + 1). A character without a piece costs the least score less `PENALTY` and gives
a token for each of its bytes (byte fallback), else one unknown token. Null and empty texts have none; pre-tokens of any
length go through the trie; of segmentations with one score the one with the shorter last piece counts; repeated rows get
equal rows and null ids stay null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .idstore import IdStore
from .sentencepiece_codec import NORMAL, UNIGRAM, USER_DEFINED, Model, marked, split_segments

PENALTY = 10.0
#: Words from which on a level of the trie is worth an array.
FEW = 8
_BASE = np.uint64(0x100000001B3 * 31 + 2)
_FILTER_BITS = 20


def unigram_scores(model: Model) -> list[float]:
    """A log probability for each id."""
    if model.model_type == UNIGRAM:
        return model.scores
    rank = {i: r for r, i in enumerate(sorted(range(len(model.pieces)), key=lambda i: (-model.scores[i], i)))}
    return [-math.log(rank[i] + 1.0) for i in range(len(model.pieces))]


class TrieCounter:
    def __init__(self, model: Model):
        scores = unigram_scores(model)
        self.pieces = {p: s for p, s, k in zip(model.pieces, scores, model.kinds) if k in (NORMAL, USER_DEFINED)}
        self.unknown, self.bytes = min(scores) - PENALTY, model.byte_fallback
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(self.pieces.values()))[order]
        if len(self.hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self._low(self.hashes)] = True
        self.powers = np.cumprod(np.concatenate([[1], np.full(self.longest + 1, _BASE)]).astype(np.uint64))
        self.store = IdStore(self._learn, 800_000, 1 << 17)  # the more words a trie has, the more they share

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _unknown_tokens(self, character: np.ndarray) -> np.ndarray:
        return 1 + (character > 0x7F) + (character > 0x7FF) + (character > 0xFFFF) if self.bytes else np.ones(len(character), np.int64)

    def _trie(self, words: list[str]) -> np.ndarray:
        """Counts of sorted distinct words: level by level of their trie, each node once, and a word's own rest alone.

        Only the last `longest` levels are kept, for words that are that long. Where few words are left, none of them has a
        prefix to share any more: the forward scores of each go on from its last node.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(size) - size
        out = np.zeros(n, np.int32)
        live = np.arange(n)
        fresh = np.zeros(n, bool)  # whether a word's node differs from that of the word before it
        before = np.zeros(n, np.uint32)
        # Of each of the last levels: hash of the prefix and node of each live word, and score and tokens of each node.
        levels = [(np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(1), np.zeros(1, np.int32))]
        d = 0
        while len(live):
            d += 1
            there = size[live] >= d
            if not there.all():
                # A word that goes leaves its successor on its own: they share no deeper node.
                gap = np.concatenate([[False], ~there[:-1]])
                fresh = (fresh | gap)[there]
                live = live[there]
                levels = [(p[there], node[there], s, t) for p, node, s, t in levels]
                before = before[: len(live)]
            if len(live) <= FEW:
                self._rest(words, live, d - 1, levels, out)
                break
            chars = flat[begin[live] + d - 1]
            fresh = fresh.copy()
            fresh[1:] |= chars[1:] != chars[:-1]
            fresh[:1] = True
            first = np.flatnonzero(fresh)  # the first word that has a node stands for it
            with np.errstate(over="ignore"):
                prefix = levels[-1][0] * _BASE + chars + np.uint64(1)
            best, count = np.full(len(first), -np.inf), np.zeros(len(first), np.int32)
            alone = np.zeros(len(first), bool)
            for length in range(1, min(self.longest, d) + 1):
                old_prefix, old_node, score, tokens = levels[-length]
                with np.errstate(over="ignore"):
                    h = prefix[first] - old_prefix[first] * self.powers[length]
                hit = np.flatnonzero(self.maybe[self._low(h)])
                at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                right = self.hashes[at] == h[hit]
                hit, at = hit[right], at[right]
                if length == 1:
                    alone[hit] = True
                parent = old_node[first[hit]]
                s = score[parent] + self.scores[at]
                better = s > best[hit]
                best[hit[better]], count[hit[better]] = s[better], tokens[parent[better]] + 1
            _, old_node, score, tokens = levels[-1]
            parent = old_node[first]
            s = score[parent] + self.unknown
            better = ~alone & (s > best)
            best[better] = s[better]
            count[better] = tokens[parent[better]] + self._unknown_tokens(chars[first[better]])
            node = np.cumsum(fresh) - 1
            levels = [*levels[-self.longest + 1 :], (prefix, node, best, count)] if self.longest > 1 else [(prefix, node, best, count)]
            end = size[live] == d
            out[live[end]] = count[node[end]]
        return out

    def _rest(self, words: list[str], live: np.ndarray, depth: int, levels: list, out: np.ndarray) -> None:
        """Counts of the live words, by plain forward scores from depth on."""
        for k, word in enumerate(live):
            text = words[word]
            best = [(float(s[node[k]]), int(t[node[k]])) for _, node, s, t in levels]  # of the last prefixes, the longest last
            for end in range(depth + 1, len(text) + 1):
                now = (-math.inf, 0)
                for n in range(1, min(self.longest, end, len(best)) + 1):
                    s = self.pieces.get(text[end - n : end])
                    if s is not None and best[-n][0] + s > now[0]:
                        now = (best[-n][0] + s, best[-n][1] + 1)
                if text[end - 1] not in self.pieces and best[-1][0] + self.unknown > now[0]:
                    now = (best[-1][0] + self.unknown, best[-1][1] + int(self._unknown_tokens(np.array([ord(text[end - 1])]))[0]))
                best = [*best[-self.longest + 1 :], now] if self.longest > 1 else [now]
            out[word] = best[-1][1]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.zeros(len(words), np.int32)
        out[order] = self._trie([words[i] for i in order])
        return out, np.ones(len(words), np.int64)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and of pre-tokens of each text."""
        codes, ends, distinct = split_segments([marked(t) for t in texts])
        number = self.store.numbers(distinct)[codes]
        upto = np.concatenate([[0], np.cumsum(self.store.flat[self.store.first[number]], dtype=np.int64)])
        return upto[ends[1:]] - upto[ends[:-1]], np.diff(ends)


@lru_cache(2)
def counter(path: str) -> TrieCounter:
    """One counter for all tasks of a Python worker."""
    return TrieCounter(Model.read(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_bytes of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, max_bytes=8 << 20):
            texts = batch.column("text").to_pylist()
            tokens, pretokens = own.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(pretokens.astype(np.int64)), pa.array([len((t or "").encode()) for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_bytes long")
