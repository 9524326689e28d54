"""A bounded store of what a Python worker has found out about distinct segments of text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np

#: Segments remembered at most; a batch with more than fit starts afresh.
SEGMENTS = 400_000
#: Segments given to learn() at once: what it makes on the way is large.
AT_ONCE = 16_384


@contextmanager
def parallel(threads: bool) -> Iterator[None]:
    """Whether the tokenizers library uses its threads, for the calls within only: workers are shared by operators."""
    before = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
    try:
        yield
    finally:
        if before is None:
            del os.environ["TOKENIZERS_PARALLELISM"]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = before


class IdStore:
    """Numbers distinct segments and keeps their ids in one flat array. learn(new segments) gives a list of ids for each."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = SEGMENTS, at_once: int = AT_ONCE):
        self.learn, self.most, self.at_once = learn, most, at_once
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        if len(self.place) + len(segments) > self.most:
            self._forget()
        new = [s for s in segments if s not in self.place]
        for at in range(0, len(new), self.at_once):
            some = new[at : at + self.at_once]
            flat, size = self.learn(some)
            self.place.update(zip(some, range(len(self.size), len(self.size) + len(some))))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered segments in turn, and where each begins, and the end."""
        return ragged(self.flat, self.first[numbers], self.size[numbers])


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[first:first + size] of each, in turn, and where each begins, and the end."""
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - upto[:-1], size)
    at += np.arange(upto[-1])
    return flat[at], upto
