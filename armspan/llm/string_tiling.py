"""Benchmark decontamination by greedy string tiling over shared word sequences."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import arrow_map, nested, pick, unnested

_WORD = re.compile(r"\w+")
_HIT = "doc_id bigint, item_id bigint, item_words int, tiled_words int, coverage double, tiles string"
# Polynomial hashing of word numbers, modulo 2**64. Equal sequences have equal hashes;
# equal hashes are verified word by word.
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class ItemIndex:
    """The word sequences of some benchmark items, by rolling hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], tile: int):
        self.tile = tile
        self._numbers: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        grams: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            found = words_of(text)
            if not found:
                continue
            ids = np.array([self._numbers.setdefault(w, len(self._numbers) + 1) for w in found], "u8")
            # An item of fewer words than a tile has to be matched as a whole.
            n = min(tile, len(ids))
            place = len(self.items)
            self.items.append((item_id, ids))
            grams[n].extend((int(h), place, j) for j, h in enumerate(_hashes(ids, n)))
        self._tables = {}
        for n, entries in grams.items():
            entries.sort()
            columns = np.array(entries, dtype=[("h", "u8"), ("item", "i8"), ("at", "i8")])
            self._tables[n] = (columns["h"].copy(), columns["item"].copy(), columns["at"].copy())

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; 0 for words that no item has."""
        get = self._numbers.get
        return np.array([get(w, 0) for w in words_of(text)], "u8")

    def seeds(self, doc: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, length, places in the document, places in the item) of all shared sequences."""
        for n, (hashes, items, places) in self._tables.items():
            if len(doc) < n:
                continue
            known = doc > 0
            whole = np.lib.stride_tricks.sliding_window_view(known, n).all(axis=1)
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            own = _hashes(doc, n)[starts]
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            hit = hi > lo
            starts, lo, count = starts[hit], lo[hit], (hi - lo)[hit]
            if not len(starts):
                continue
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            left, item, right = np.repeat(starts, count), items[at], places[at]
            order = np.lexsort((right, left, item))
            left, item, right = left[order], item[order], right[order]
            cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield int(item[a]), n, left[a:b], right[a:b]


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every run of ``n`` word numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), "u8")
    for k in range(n):
        power = np.uint64(pow(_BASE, n - 1 - k, 1 << 64))
        out += ids[k : k + len(out)] * power
    return out


def tile(doc: np.ndarray, item: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length): the longest unmarked match first.

    ``left`` and ``right`` are the seeds of length ``n``. Runs of seeds on a diagonal are the
    maximal matches; a match that meets marked words falls apart into its unmarked stretches,
    which compete anew. Ties go to the earlier place in the item, then in the document.
    """
    same = np.all([doc[left + k] == item[right + k] for k in range(n)], axis=0)
    left, right = left[same], right[same]
    order = np.lexsort((left, left - right))
    left, right = left[order], right[order]
    new = np.concatenate(([True], (np.diff(left - right) != 0) | (np.diff(left) != 1)))[: len(left)]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.concatenate((starts, [len(left)]))) + n - 1
    heap = [(-int(m), int(right[s]), int(left[s])) for s, m in zip(starts, lengths, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    while heap:
        length, j, i = heapq.heappop(heap)
        free = ~(in_doc[i : i - length] | in_item[j : j - length])
        if free.all():
            in_doc[i : i - length] = in_item[j : j - length] = True
            tiles.append((i, j, -length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view("i1"), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= n:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return tiles


def leaks(
    df: DataFrame, benchmark: DataFrame, min_words: int = 5, coverage: float = 0.8, block_bytes: int = 8_388_608
) -> DataFrame:
    """Documents that hold a benchmark item, in one piece or in several in any order.

    One row for each document and item whose tiles of at least ``min_words`` words cover at
    least ``coverage`` of the item's words: doc_id, item_id, item_words, tiled_words, coverage
    and tiles (document word:item word:length, comma-joined, in document order).

    Items are read in blocks of about ``block_bytes`` of text, and each block is matched with
    all documents in one scan: what a task holds of the benchmark is bounded however large it
    is. Seeds are equal runs of ``min_words`` words, found by rolling hash; only items whose
    seeds can reach the coverage are tiled. An item of fewer words than ``min_words`` has to
    occur as a whole; an item without words is never found. Null texts hold nothing. Repeated
    rows and null ids give rows of their own; equal items give a row each. Extra columns are
    ignored; if a table is empty there are no rows.
    """
    return _hits(pick(df, "doc_id", "text"), benchmark, min_words, coverage, block_bytes)


def without_leaks(
    df: DataFrame, benchmark: DataFrame, min_words: int = 5, coverage: float = 0.8, block_bytes: int = 8_388_608
) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, unchanged, whatever their ids are.

    Null and empty texts hold none; repeated rows stay or go together. Extra columns stay, whatever their
    names; an empty table gives no rows, and an empty benchmark leaves all.
    """
    rows, col = nested(df)
    for items in _blocks(benchmark, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(ItemIndex(items, min_words))
        rows = rows.where(~_leak_test(shared, coverage)(col("text")))
    return unnested(rows, df.columns)


def _leak_test(shared: Broadcast, coverage: float):
    @F.pandas_udf("boolean")
    def leaking(texts: pd.Series) -> pd.Series:
        return pd.Series([any(True for _ in _tilings(shared.value, text, coverage)) for text in texts], dtype=bool)

    return leaking


def _tilings(index: ItemIndex, text: str | None, coverage: float) -> Iterator[tuple]:
    """(item number, item words, tiled words, tiles) of each item that the text covers."""
    doc = index.numbers(text)
    for place, n, left, right in index.seeds(doc):
        item = index.items[place][1]
        # The words that seeds touch bound what tiles can cover.
        covered = np.zeros(len(item) + 1, "i8")
        np.add.at(covered, right, 1)
        np.add.at(covered, right + n, -1)
        if np.count_nonzero(np.cumsum(covered)) < coverage * len(item):
            continue
        tiles = sorted(tile(doc, item, n, left, right))
        total = sum(length for _, _, length in tiles)
        if total >= coverage * len(item):
            yield place, len(item), total, tiles


def _hits(rows: DataFrame, benchmark: DataFrame, min_words: int, coverage: float, block_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    found = None
    for items in _blocks(benchmark, block_bytes):
        # Bounded by block_bytes.
        shared = spark.sparkContext.broadcast(ItemIndex(items, min_words))

        def each(given: Iterator[dict], shared=shared) -> Iterator[tuple]:
            index = shared.value
            for row in given:
                for place, words, total, tiles in _tilings(index, row["text"], coverage):
                    text = ",".join(f"{i}:{j}:{length}" for i, j, length in tiles)
                    yield row["doc_id"], index.items[place][0], words, total, total / words, text

        part = arrow_map(rows, each, _HIT)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _HIT) if found is None else found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items, a bounded number of bytes at a time."""
    held, weight = [], 0
    for item_id, text in pick(benchmark, "item_id", "text").toLocalIterator():
        held.append((item_id, text))
        weight += len((text or "").encode())
        if weight >= block_bytes:
            yield held
            held, weight = [], 0
    if held:
        yield held
