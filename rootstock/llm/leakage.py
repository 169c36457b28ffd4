"""Evaluation texts within training documents, by greedy string tiling.

Passages are words as a reader sees them (`rootstock.llm.text`).  Their three-word sequences are seeds,
held in an index that every task gets in parts; documents are read and cut into words once and nothing is shuffled.  A document
and a passage that share enough seeds are tiled: the longest common run of unmarked words is found by running
Karp-Rabin hashes and marked, again and again down to three words.  The share of the passage that tiles cover, in
whatever order, is thresholded; an exact count of runs and shared sequences may decide among what remains.

Words stand for themselves as 64-bit hashes, and sequences as hashes of these; with 2^64 of them, two that differ and
are taken for one aren't to be expected.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootstock.llm.text import LIFTED, apart, decoded, readable, words

SEED = 3
_BASE, _MOD = 1_000_003, (1 << 61) - 1
#: Bits of the table that most sequences of a document are refuted by.
_TABLE = 1 << 22


def _common(p: list[int], d: list[int], pm: list[bool], dm: list[bool], length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in p, start in d) of at least `length` unmarked words, by rolling hashes; 0 in d matches nothing."""
    power = pow(_BASE, length - 1, _MOD)

    def rolling(x: list[int], marked: list[bool]) -> Iterator[tuple[int, int]]:
        h, n = 0, 0
        for i, w in enumerate(x):
            if marked[i] or not w:
                h, n = 0, 0
                continue
            if n == length:
                h = (h - x[i - length] * power) % _MOD
                n -= 1
            h, n = (h * _BASE + w) % _MOD, n + 1
            if n == length:
                yield i - length + 1, h

    table = defaultdict(list)
    for i, h in rolling(p, pm):
        table[h].append(i)
    out = []
    for j, h in rolling(d, dm):
        for i in table.get(h, ()):
            if i and j and not pm[i - 1] and not dm[j - 1] and p[i - 1] == d[j - 1]:
                continue  # begins further left
            k = 0
            while i + k < len(p) and j + k < len(d) and p[i + k] == d[j + k] and not pm[i + k] and not dm[j + k]:
                k += 1
            if k >= length:
                out.append((k, i, j))
    return out


def greedy_tiles(p: list[int], d: list[int], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (length, start in p, start in d), longest first."""
    pm, dm, tiles, length = [False] * len(p), [False] * len(d), [], min(20, max(shortest, len(p)))
    while True:
        found = _common(p, d, pm, dm, length)
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(pm[i : i + k]) and not any(dm[j : j + k]):
                tiles.append((k, i, j))
                pm[i : i + k] = dm[j : j + k] = [True] * k
            # A match that a longer tile cut into comes again, shortened, with a smaller length.
        if length == shortest and not any(_common(p, d, pm, dm, length)):
            return sorted(tiles, reverse=True)
        length = max(shortest, length // 2)


_RUNS = re.compile(r"(?:[\W_]*[^\W_]+){0,3}")
#: Marks whose removal may make markup of what is around them.
_TOUCHING = re.compile(r"[\[\]<>'&|{}]\x00|\x00[\[\]<>'&|{};]|<[^<>]*\x00[^<>]*>|&[#\w]*\x00")


def _around(text: str) -> str | None:
    """What can hold a sequence of three words that marks of lifted text stood in; None if that can't be told from a part.

    Such a sequence begins at most three runs of letters before the first mark in it, ends at most three behind the last and has at most three
    between two.  text is `apart`, made readable.
    """
    back, n, spans = text[::-1], len(text), []
    at = text.find(LIFTED)
    while at >= 0:
        left, right = n - _RUNS.match(back, n - at).end(), _RUNS.match(text, at + 1).end()
        if spans and left <= spans[-1][1]:
            spans[-1][1] = max(right, spans[-1][1])
        else:
            spans.append([left, right])
        at = text.find(LIFTED, at + 1)
    return "\n".join(text[a:b] for a, b in spans).replace(LIFTED, "")


class _Codes(dict):
    """64-bit hash of a word, never 0, by the word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h


_codes = _Codes()
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_codes(text: str) -> np.ndarray:
    """Hashes of the words of readable text."""
    return np.frombuffer(array("Q", map(_codes.__getitem__, words(text))), np.uint64)


def _keys(codes: np.ndarray) -> np.ndarray:
    """One number per sequence of three words."""
    if len(codes) < SEED:
        return np.zeros(0, np.uint64)
    k = codes[:-2] * _A + codes[1:-1] * _B + codes[2:] * _C
    return (k ^ (k >> np.uint64(32))) * _C


@dataclass(frozen=True)
class PassageIndex:
    """Distinct passages as word codes, and which of them hold a seed."""

    passages: list[np.ndarray]
    keys: list[np.ndarray]
    items: list[list[int]]
    seeds: np.ndarray
    holders: list[list[int]]
    distinct: list[int]

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str | None]]) -> PassageIndex:
        by_words: dict[bytes, list[int]] = defaultdict(list)
        for number, passage in rows:
            if passage:
                by_words[word_codes(readable(decoded(passage))).tobytes()].append(number)
        by_words.pop(b"", None)
        passages = [np.frombuffer(p, np.uint64) for p in by_words]
        keys = [_keys(p) for p in passages]
        held = defaultdict(list)
        for n, k in enumerate(keys):
            for x in np.unique(k).tolist():
                held[x].append(n)
        seeds = np.array(sorted(held), np.uint64)
        return cls(passages, keys, list(by_words.values()), seeds, [held[k] for k in seeds.tolist()], [len(np.unique(k)) for k in keys])


Views = list[np.ndarray]


def views_of(text: str, may_hold) -> Views:
    """Word codes of a text as it stands and, where that can add sequences, with footnotes and templates lifted out.

    may_hold(codes) tells whether any sequence of the words is a seed of some passage.
    """
    plain = decoded(text)
    views = [word_codes(readable(plain))]
    other = apart(plain)
    if other is not None:
        # Only where something was lifted out can there be sequences that the text in place hasn't.
        if not may_hold(views[0]) and not _TOUCHING.search(other) and not may_hold(word_codes(_around(readable(other)))):
            return views
        views.append(word_codes(readable(other.replace(LIFTED, ""))))
    return views


class Seeds:
    """Seeds of an index and a table that refutes most other sequences at once."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds
        self.table = np.zeros(_TABLE, bool)
        self.table[(seeds & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Index numbers of the seeds in a text."""
        keys = _keys(codes)
        keys = keys[self.table[(keys & np.uint64(_TABLE - 1)).astype(np.int64)]]
        if not len(keys) or not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        return np.unique(at[self.seeds[at] == keys])


class Matcher:
    """Finds an index's passages in texts.

    Without `coverage`, those of which a text holds `run` consecutive words or the share `share` of the distinct sequences of three words.
    A run is a tile, so it covers at least run words.  Where k distinct sequences are shared, every one of them touches a tile in
    the passage or, wherever it stands, one in the text, and a tile of w words is touched by at most w + 2 <= 5/3 w sequences in
    each: tiles cover at least 0.3 k words, half of that in the better one of two views.  Tiles below the lesser of
    these bounds are left out before anything is counted.  With `coverage`, passages of which tiles cover that share.
    """

    def __init__(self, index: PassageIndex, run: int, share: float, coverage: float | None = None):
        self.index, self.run, self.share, self.coverage = index, run, share, coverage
        self.seeds = Seeds(index.seeds)

    def __call__(self, text: str) -> list[tuple[int, int, float, float]]:
        """(passage, longest run, share of its distinct sequences, share of its words covered by tiles) of the passages found."""
        return self.among(views_of(text, lambda c: len(self.seeds.found(c)) > 0))

    def among(self, views: Views) -> list[tuple[int, int, float, float]]:
        shared: dict[int, set[int]] = defaultdict(set)
        for codes in views:
            for k in self.seeds.found(codes).tolist():
                for n in self.index.holders[k]:
                    shared[n].add(k)
        out = []
        for n, held in shared.items():
            p, share = self.index.passages[n], len(held) / self.index.distinct[n]
            if not self._may(n, held, share):
                continue
            words_of, longest, covered = p.tolist(), 0, 0.0
            for codes in views:
                tiles = greedy_tiles(words_of, self._local(p, codes))
                longest = max([longest, *(k for k, _, _ in tiles)])
                covered = max(covered, sum(k for k, _, _ in tiles) / len(p))
            if self.coverage is not None:
                if covered >= self.coverage:
                    out.append((n, longest, share, covered))
            elif covered * len(p) >= min(self.run, 0.15 * self.share * self.index.distinct[n]) - 1e-9 and (longest >= self.run or share >= self.share):
                out.append((n, longest, share, covered))
        return out

    def _may(self, n: int, held: set[int], share: float) -> bool:
        """Whether tiling can give the passage: its places whose sequences are shared bound runs and coverage from above."""
        if self.coverage is None and share >= self.share:
            return True
        if self.index.distinct[n] == len(self.index.keys[n]) and len(held) < (self.run - SEED + 1 if self.coverage is None else self.coverage * len(self.index.passages[n]) / SEED):
            return False  # no sequence comes twice, so there are no more places than these
        here = np.isin(self.index.keys[n], self.index.seeds[list(held)])
        if self.coverage is not None:
            reach = np.r_[here, False, False] | np.r_[False, here, False] | np.r_[False, False, here]
            return reach.mean() >= self.coverage
        gaps = np.flatnonzero(np.r_[True, ~here, True])
        return int(np.diff(gaps).max()) - 1 >= self.run - SEED + 1

    @staticmethod
    def _local(p: np.ndarray, codes: np.ndarray) -> list[int]:
        """The text's words that the passage has; what lies between them becomes one 0."""
        mine = np.where(np.isin(codes, p), codes, np.uint64(0))
        keep = (mine > 0) | np.r_[True, mine[:-1] > 0]
        return mine[keep].tolist()


def leaked(documents: DataFrame, passages: DataFrame, *, doc_id: str, text: str, item: str, passage: str, run: int = 12, share: float = 0.5, coverage: float | None = None, words_per_block: int = 400_000, most_words: int = 50_000_000) -> DataFrame:
    """(item, doc_id, longest_run, share, covered): documents that hold at least `run` consecutive words of a passage or `share` of its
    distinct three-word sequences; with `coverage`, those of which tiles of three and more words cover that share of the passage's words, in whatever order.

    Passages are taken to the driver in blocks of at most about `words_per_block` words, each of which is broadcast as a part of the
    index; more than `most_words` are refused.  Documents are read and cut into words once, whatever the number of blocks, and a task
    holds one block at a time.  Items with the same passage all come out.  Empty and NULL texts and passages, and passages of fewer than three words, match nothing.
    Repeated documents each give their rows.  No passages or documents give no rows.
    """
    spark = documents.sparkSession
    schema = f"item bigint, doc_id {documents.schema[doc_id].dataType.simpleString()}, longest_run int, share double, covered double"
    slim = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    parts: list[Broadcast] = []
    seeds, total = [], 0
    for block in _blocks(passages.select(F.col(f"`{item}`").cast("bigint"), F.col(f"`{passage}`")).toLocalIterator(), words_per_block):
        index = PassageIndex.of(block)
        total += sum(map(len, index.passages))
        if total > most_words:
            raise ValueError(f"more than {most_words} words of passages")
        seeds.append(index.seeds)
        parts.append(spark.sparkContext.broadcast(index))
    if not parts:
        return spark.createDataFrame([], schema)
    every = spark.sparkContext.broadcast(np.unique(np.concatenate(seeds))) if len(parts) > 1 else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: list[Matcher] = []
        all_seeds = Seeds(every.value if every else parts[0].value.seeds)
        may_hold = lambda c: len(all_seeds.found(c)) > 0
        for b in batches:
            # A text that holds no seed needs no part of the index.
            held = [(k, views) for k, t in enumerate(b.column(1).to_pylist()) if any(map(may_hold, views := views_of(t, may_hold)))]
            rows = []
            for part in parts if held else ():
                if len(parts) == 1:
                    matchers = matchers or [Matcher(part.value, run, share, coverage)]
                    matcher = matchers[0]
                else:
                    matcher = Matcher(_one(part), run, share, coverage)
                rows += [(i, k, *found[1:]) for k, views in held for found in matcher.among(views) for i in matcher.index.items[found[0]]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            ids = b.column(0).take(pa.array(columns[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), ids, pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64())], names=["item", "doc_id", "longest_run", "share", "covered"])

    return slim.mapInArrow(find, schema)


def _one(part: Broadcast) -> PassageIndex:
    """A part of the index, not held beyond its use."""
    path = getattr(part, "_path", None)
    return part.load_from_path(path) if path and not hasattr(part, "_value") else part.value


def _blocks(rows: Iterable[Sequence], limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for number, passage in rows:
        if number is None or not passage:
            continue
        block.append((number, passage))
        size += len(passage) // 4
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block
