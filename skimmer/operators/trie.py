"""A trie over code points, walked for a batch of texts at once: all places of all patterns, overlaps included.

It is built level by level from sorted patterns: a level maps (state, character) to the next state. A walk begins at every place
of every text; places without a next state drop out, so work follows what the texts share with the patterns, not their number.
Patterns reach each worker once and are built there once. Empty patterns match nothing; repeated ones count once.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE = 1 << 22  # entries up to which a level is a table; else it is searched
PIECE = 1 << 19  # code points that are walked at a time


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, where each text ends)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


class Trie:
    def __init__(self, patterns: list[str]):
        self.patterns = sorted(set(patterns) - {""})
        flat, ends = code_points(self.patterns)
        begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        used = np.unique(flat)
        self.width = len(used) + 1  # the last letter stands for all that no pattern has
        self.letters = np.full(0x110000, len(used), np.int32)
        self.letters[used] = np.arange(len(used))
        flat = self.letters[flat].astype(np.int64)
        self.levels, state, which, states = [], np.zeros(len(ends), np.int64), np.arange(len(ends)), 1
        while len(which):  # patterns that are longer than the levels so far
            keys, to = np.unique(state[which] * self.width + flat[begins[which] + len(self.levels)], return_inverse=True)
            state[which] = to
            over = ends[which] - begins[which] == len(self.levels) + 1
            last = np.full(len(keys), -1, np.int64)
            last[to[over]] = which[over]
            table = None
            if states * self.width <= DENSE:
                table = np.full(states * self.width, -1, np.int32)
                table[keys] = np.arange(len(keys))
            self.levels.append((keys, table, last))
            which, states = which[~over], len(keys)
        self.lengths = ends - begins

    def _next(self, depth: int, want: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is none."""
        keys, table, _ = self.levels[depth]
        if table is not None:
            return table[want]
        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[found] == want, found, -1)

    def _pieces(self, texts: list[str]):
        """(first, past the last) of texts that are walked together: PIECE code points, or one text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
                size += len(texts[to])
                to += 1
            yield at, to
            at = to

    def walk(self, texts: list[str]):
        """Pieces of (text, start, pattern), numbers all."""
        for at, to in self._pieces(texts):
            for row, start, pattern in self._walk(texts[at:to]):
                yield row + at, start, pattern

    def _walk(self, texts: list[str]):
        flat, ends = code_points(texts)
        if not len(flat) or not self.levels:
            return
        letters = self.letters[flat]
        begin = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        state = self._next(0, letters)
        place = np.flatnonzero(state >= 0)
        state = state[place].astype(np.int64)
        end = np.repeat(ends, ends - begin)
        for depth, (_, _, last) in enumerate(self.levels):
            done = last[state]
            hit = np.flatnonzero(done >= 0)
            if len(hit):
                p = place[hit]
                row = np.searchsorted(ends, p, "right")
                yield row, p - begin[row], done[hit]
            if depth + 1 == len(self.levels):
                return
            more = place + depth + 1 < end[place]
            place, state = place[more], state[more]
            state = self._next(depth + 1, state * self.width + letters[place + depth + 1])
            same = np.flatnonzero(state >= 0)
            place, state = place[same], state[same].astype(np.int64)
            if not len(place):
                return

    def counted(self, texts: list[str]):
        """Pieces of (text, pattern, n), by text, each text in one: places are held a piece at a time, not those of a whole batch."""
        size = len(self.patterns)
        for at, to in self._pieces(texts):
            each = [row * size + pattern for row, _, pattern in self._walk(texts[at:to])]
            if each:
                places = np.concatenate(each)
                if (to - at) * size <= 4 * len(places):  # few patterns: a table of all, with no sorting
                    n = np.bincount(places)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(places, return_counts=True)
                yield key // size + at, key % size, n

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, n), by text."""
        parts = list(self.counted(texts))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        row, pattern, n = (np.concatenate(x) for x in zip(*parts))
        return row, pattern, n


_built: OrderedDict = OrderedDict()


def built(shared) -> Trie:
    """The trie of a broadcast list, built once a worker; a few are kept, with their lists, so that none is taken for another."""
    value = shared.value
    if id(value) not in _built:
        _built[id(value)] = value, Trie(value)
        while len(_built) > 4:
            _built.popitem(last=False)
    return _built[id(value)][1]


def shared_patterns(spark: SparkSession, patterns: list[str]):
    return spark.sparkContext.broadcast(sorted(set(patterns) - {""}))


def gathered(words: DataFrame, column: str, most: int = 2_000_000) -> list[str] | None:
    """The distinct values of a column that are to be a trie, or None if there are more than most: they reach every worker."""
    rows = words.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1)
    found = rows.toArrow().column(0).to_pylist()
    return found if len(found) <= most else None


def occurrences(text: Column, patterns) -> Column:
    """array<struct<word, start, end>> of all places of the patterns (from shared_patterns), from 0, end exclusive, by start, then
    length. Null for a null text."""

    @F.pandas_udf("array<struct<word: string, start: int, end: int>>")
    def run(texts):
        import pandas as pd

        trie = built(patterns)
        rows = [t or "" for t in texts]
        out: list = [[] for _ in rows]
        parts = list(trie.walk(rows))
        if parts:
            row, start, pattern = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((trie.lengths[pattern], start, row))
            for r, s, p in zip(row[order].tolist(), start[order].tolist(), pattern[order].tolist()):
                out[r].append((trie.patterns[p], s, s + int(trie.lengths[p])))
        return pd.Series([[{"word": w, "start": s, "end": e} for w, s, e in x] if t is not None else None for x, t in zip(out, texts)])

    return run(text)


def contained(text: Column, patterns) -> Column:
    """array<string> of the patterns that stand anywhere in the text."""

    @F.pandas_udf("array<string>")
    def run(texts):
        import pandas as pd

        trie = built(patterns)
        row, pattern, _ = trie.counts([t or "" for t in texts])
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        return pd.Series([[trie.patterns[p] for p in pattern[a:b]] if t is not None else None for a, b, t in zip(cut[:-1], cut[1:], texts)])

    return run(text)


def pattern_rows(docs: DataFrame, key: str, text: Column, patterns) -> DataFrame:
    """(key, word, n) of the patterns that a row's text holds; nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        trie = built(patterns)
        names = pa.array(trie.patterns, pa.string())
        for b in batches:
            for row, pattern, n in trie.counted([t or "" for t in b.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(pattern)), pa.array(n)], [key, "word", "n"])

    return docs.select(key, text.alias("__text")).mapInArrow(run, f"`{key}` {kind}, word string, n long")


def place_rows(docs: DataFrame, key: str, text: Column, patterns) -> DataFrame:
    """(key, word, start, end), a row for each place."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        trie = built(patterns)
        names = pa.array(trie.patterns, pa.string())
        for b in batches:
            for row, start, pattern in trie.walk([t or "" for t in b.column(1).to_pylist()]):
                cols = [b.column(0).take(pa.array(row)), names.take(pa.array(pattern)), pa.array(start), pa.array(start + trie.lengths[pattern])]
                yield pa.RecordBatch.from_arrays(cols, [key, "word", "start", "end"])

    return docs.select(key, text.alias("__text")).mapInArrow(run, f"`{key}` {kind}, word string, start long, end long")
