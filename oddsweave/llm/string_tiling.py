"""Benchmark decontamination by greedy string tiling.

Benchmark items are tokenised (lower case, runs of letters, digits and bytes
beyond ASCII) and every run of ``least`` tokens gets a running Karp-Rabin hash.
Documents roll the same hash; what they share with items are seeds.  The places
of an item that its seeds in a document reach bound what tiles can cover; pairs
that can't reach ``coverage`` end there.

For the others, greedy tiling marks the longest run of unmarked tokens that
both have, then the next longest, until none of ``least`` tokens is left.  The
longest length is found by bisection over running hashes of that length, so a
pair needs memory for its tokens, however often they repeat.  An item whose
tokens are tiled to a share of ``coverage`` or more contaminates the document,
in whatever order its passages stand.

The benchmark is a stated set of queries.  It goes to the tasks in blocks of at
most ``BLOCK_BYTES`` of text, so what is broadcast has a bound; documents are
scanned where they lie, without a shuffle, once for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import Words, mix, row_key, slabs

BLOCK_BYTES = 8 << 20
#: Places of items that documents reach, compared at once in a task.
REACHED = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Tiling:
    """``least``: tokens of the shortest tile (shorter items are never found); ``coverage``: share of an item's tokens in tiles."""

    least: int = 5
    coverage: float = 0.5


def tokens(data: np.ndarray, at: np.ndarray) -> Words:
    return Words(data, at, lower=True, space=_APART)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def karp_rabin(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of all runs of ``n`` tokens inside one text, and where they start."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
    out = mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])
    inside = np.ones(len(out), bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(out))]] = False
    at = np.flatnonzero(inside)
    return out[at], at


class Items:
    """Seeds of a block of the benchmark, sorted, with the item and place of each."""

    def __init__(self, ids: list, texts: list[str], rule: Tiling):
        raw = [(t or "").encode() for t in texts]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        w = tokens(np.frombuffer(b"".join(raw), np.uint8), at)
        self.words = w.hashes()
        seeds, start = karp_rabin(self.words, w.first, rule.least)
        item = np.searchsorted(w.first, start, side="right") - 1
        order = np.argsort(seeds, kind="stable")
        self.rule, self.ids, self.length, self.first = rule, ids, w.per_doc, w.first
        self.seeds, self.item, self.place = seeds[order], item[order], (start - w.first[item])[order]

    def reached(self, words: np.ndarray, first: np.ndarray):
        """(document, item) of all pairs whose shared seeds reach ``coverage`` of the item's tokens; no tiling covers more."""
        h, start = karp_rabin(words, first, self.rule.least)
        low = np.searchsorted(self.seeds, h)
        hit = np.flatnonzero(low < len(self.seeds))
        hit = hit[self.seeds[low[hit]] == h[hit]]
        doc = np.searchsorted(first, start[hit], side="right") - 1
        seen = np.unique(doc * len(self.seeds) + low[hit])  # a seed counts once in a document, however often it repeats there
        doc, low = seen // max(1, len(self.seeds)), seen % max(1, len(self.seeds))
        many = np.searchsorted(self.seeds, self.seeds[low], side="right") - low
        ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)) if len(doc) else []
        total = np.concatenate(([0], np.cumsum(many)))
        a = 0
        for b, end in zip(ends, [*ends[1:], None]):  # documents as they fit; one alone reaches each place once at most
            if end is not None and total[end] - total[a] <= REACHED:
                continue
            k = np.repeat(low[a:b] - (total[a:b] - total[a]), many[a:b]) + np.arange(int(total[b] - total[a]))
            owner, item, place = np.repeat(doc[a:b], many[a:b]), self.item[k], self.place[k]
            order = np.lexsort((place, item, owner))
            owner, item, place = owner[order], item[order], place[order]
            pair = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(item) != 0))))
            step = np.append(np.diff(place), self.rule.least)
            step[np.append(pair[1:], len(owner)) - 1] = self.rule.least
            good = np.add.reduceat(np.minimum(step, self.rule.least), pair) >= self.rule.coverage * self.length[item[pair]]
            yield from zip(owner[pair[good]].tolist(), item[pair[good]].tolist())
            a = b

    def found(self, w: Words) -> list[tuple[int, int, float, int, int, str]]:
        """(document, item, coverage, tiles, longest tile, spans) of all pairs that reach the coverage."""
        out, words = [], w.hashes()
        for d, i in self.reached(words, w.first):
            tiles = tile(self.words[self.first[i] : self.first[i + 1]], words[w.first[d] : w.first[d + 1]], self.rule.least)
            covered = sum(n for *_, n in tiles)
            if covered >= self.rule.coverage * self.length[i]:
                out.append((d, i, covered / int(self.length[i]), len(tiles), max(n for *_, n in tiles), ",".join(f"{p}:{s}:{n}" for p, s, n in sorted(tiles))))
        return out


class _Runs:
    """Running hashes of all runs of unmarked tokens of one text, of whatever length is asked for."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
        self.marked = np.zeros(len(words), bool)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``n`` tokens without a mark, and where they start."""
        marks = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return mix((self.total[at + n] - self.total[at]) * self.down[at]), at


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, tokens) of two lists of token hashes.

    The longest run of unmarked tokens that both have comes first; of equal
    length, the one that stands first in the item, then in the document.
    """
    a, b = _Runs(item), _Runs(doc)
    tiles, most = [], min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most  # runs of ``low`` tokens are shared (or too short to matter), longer than ``high`` none
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(a.of(n)[0], b.of(n)[0]).any():
                low = n
            else:
                high = n - 1
        if low < least:
            break
        (mine, at), (other, to) = a.of(low), b.of(low)
        shared = np.isin(mine, other)
        order = np.argsort(other, kind="stable")
        other, to = other[order], to[order]
        begin = np.searchsorted(other, mine[shared])
        end = np.searchsorted(other, mine[shared], side="right").tolist()
        tried: dict[int, int] = {}  # of each run: how many of its places in the document are behind
        free = 0
        for p, k, stop in zip(at[shared].tolist(), begin.tolist(), end):
            if p < free:
                continue
            x = tried.get(k, k)
            while x < stop and b.marked[to[x] : to[x] + low].any():
                x += 1
            tried[k] = x
            if x < stop:
                s = int(to[x])
                tiles.append((p, s, low))
                a.marked[p : p + low] = True
                b.marked[s : s + low] = True
                free = p + low
        most = low - 1
    return tiles


def blocks(benchmark: DataFrame, rule: Tiling, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark in broadcast blocks of about ``block_bytes`` of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(row_key(benchmark, key).alias("item"), F.col(text).alias("text")).filter(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-size // block_bytes)
    out = []
    for k in range(many):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k).collect() if many > 1 else rows.collect()
        out.append(spark.sparkContext.broadcast(Items([r["item"] for r in part], [r["text"] for r in part], rule)))
    return out


_PAIRS = "row_id long, item_id long, coverage double, n_tiles int, longest int, tiles string"


def _search(items):
    def run(batches):
        for batch in batches:
            for lo, _, data, at in slabs(batch):
                rows = items.value.found(tokens(data, at))
                if rows:
                    doc, item, *rest = zip(*rows)
                    ids = [items.value.ids[i] for i in item]
                    yield pa.record_batch([batch.column(0).take(pa.array([lo + d for d in doc])), pa.array(ids, pa.int64()), pa.array(rest[0], pa.float64()), pa.array(rest[1], pa.int32()), pa.array(rest[2], pa.int32()), pa.array(rest[3])], names=[x.split()[0] for x in _PAIRS.split(", ")])

    return run


def pairs(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling(), key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document row and item that contaminates it: coverage, tiles (item place:document place:tokens).

    Null and empty texts and items, and items of fewer than ``least`` tokens,
    find nothing; repeated rows on either side give repeated rows; an empty side
    gives no rows; keys are whole numbers or null; other columns are not read.
    """
    rows = docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], _PAIRS)
    for k, block in enumerate(blocks(benchmark, rule, item, text)):
        part = rows.mapInArrow(_search(block), _PAIRS)
        out = out.unionByName(part) if k else part
    return out


def keep(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling(), text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they were; no join, no shuffle.

    Null and empty texts stay, and so do all rows if there are no items; rows
    that repeat stay or go together.
    """

    def clean(items):
        def run(batches):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for lo, _, data, at in slabs(batch, text):
                    good[[lo + r[0] for r in items.value.found(tokens(data, at))]] = False
                yield batch.filter(pa.array(good))

        return run

    for block in blocks(benchmark, rule, item, text):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs
