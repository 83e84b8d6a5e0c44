"""Importance resampling towards a target corpus, on hashed word n-grams.

A block of documents gets a dictionary of its words, numbered; its n-grams are
tuples of numbers (a pair has a number of its own, a triple is a pair and a
word).  The bytes of each distinct tuple are rebuilt and hashed once, and the
result is joined back to all places of the tuple by its number.  Only counts by
bucket leave the block, so the corpus is never shuffled and the number of
distinct n-grams in it doesn't matter.

A text longer than a block is cut behind a word; each further part begins with
the two words before it, whose own n-grams have been counted already.

Scores are ranked by sorted ranges: places inside a range and the sizes of the
ranges before it give the rank, so no task sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.llm._shared import SLAB_BYTES, Words, row_key, stored, text_bytes

ORDER = 3
BUCKETS = 10_000
#: Bytes that part words: all of ASCII but digits and letters.
_APART = np.zeros(256, bool)
_APART[:0x30] = _APART[0x3A:0x61] = _APART[0x7B:0x80] = True
_APART_RAW = _APART.copy()
_APART_RAW[0x41:0x5B] = False


def blocks(data: np.ndarray, at: np.ndarray, size: int = SLAB_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of at most ``size`` bytes: row of each text, bytes, offsets, how many of its first words are there for context alone.

    A longer text is cut at the first byte that parts words after ``size`` bytes.
    """
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        if end > row + 1 or at[end] - at[row] <= size:
            yield np.arange(row, end), data[at[row] : at[end]], at[row : end + 1] - at[row], np.zeros(end - row, np.int64)
        else:
            yield from _parts(row, data[at[row] : at[end]], size)
        row = end


def _parts(row: int, text: np.ndarray, size: int):
    apart = _APART_RAW[text]
    begin, context, words = 0, text[:0], 0
    while begin < len(text):
        end = begin + size
        while end < len(text) and not apart[end]:
            step = np.flatnonzero(apart[end : end + size])
            end = end + int(step[0]) if len(step) else end + size
        end = min(end, len(text))
        part = np.concatenate((context, text[begin:end]))
        yield np.array([row]), part, np.array([0, len(part)], np.int64), np.array([words])
        edge = np.diff(np.concatenate(([True], _APART_RAW[part], [True])).view(np.int8))
        last = list(zip(np.flatnonzero(edge == -1)[1 - ORDER :], np.flatnonzero(edge == 1)[1 - ORDER :]))
        context, words = np.concatenate([text[:0], *(np.append(part[a:b], np.uint8(0x20)) for a, b in last)]), len(last)
        begin = end


class Tuples:
    """The n-grams of one to three words of a block: for each order, the owner of every occurrence, its tuple's number, and the crc32 of each distinct tuple."""

    def __init__(self, data: np.ndarray, at: np.ndarray, context: np.ndarray):
        words = Words(data, at, lower=True, space=_APART)
        count = len(words.starts)
        lengths = words.ends - words.starts
        raw = words.data[~_APART[words.data]]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        ids = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = spelled.dictionary.to_pylist()
        later = [b" " + x for x in names]
        owner = words.doc_of()
        place = np.arange(count) - words.first[:-1][owner] if count else np.zeros(0, np.int64)
        fresh = place >= context[owner] if count else np.zeros(0, bool)
        self.words = np.bincount(owner[fresh], minlength=len(at) - 1)
        hashes = np.fromiter(map(crc32, names), np.uint32, len(names))
        self.orders = [(owner[fresh], ids[fresh], hashes)]
        number = ids
        for n in range(2, ORDER + 1):
            ends = np.flatnonzero(place >= n - 1)  # words that end a run of n inside one text
            # ``number`` is by the place of the run's last word; a run is the run before it and one word.
            keys = number[ends - 1] * np.int64(max(1, len(names))) + ids[ends]
            distinct, inverse = np.unique(keys, return_inverse=True)
            before, last = np.divmod(distinct, max(1, len(names)))
            hashes = np.fromiter(map(crc32, map(later.__getitem__, last.tolist()), hashes[before].tolist()), np.uint32, len(distinct))
            number = np.zeros(count, np.int64)
            number[ends] = inverse
            use = fresh[ends]
            self.orders.append((owner[ends][use], inverse[use], hashes))


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at, context in blocks(*text_bytes(batch.column(0))):
                for _, inverse, hashes in Tuples(data, at, context).orders:
                    total += np.bincount(hashes % buckets, np.bincount(inverse, minlength=len(hashes)), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts lie in each bucket (``bucket``, ``n``); empty buckets have no row.  Null texts count as empty."""
    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_counts(buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in the target and in the corpus; as many numbers as there are buckets."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))  # at most ``buckets`` rows each
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * float(all_s + buckets) / ((s.get(b, 0) + 1) * float(all_t + buckets)))) for b in range(buckets)]


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for row, data, at, context in blocks(*text_bytes(batch.column(1))):
                found = Tuples(data, at, context)
                words[row] += found.words
                for owner, inverse, hashes in found.orders:
                    weight[row] += np.bincount(owner, gain[hashes % len(gain)][inverse], len(row)).astype(np.int64)
                    features[row] += np.bincount(owner, minlength=len(row))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["row_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, ``n_words``, ``n_features``, ``weight`` of every row; a text without a word weighs nothing."""
    given = docs.select(row_key(docs, key).alias("row_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(_weights(np.array(gain, np.int64)), "row_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """``weighed`` with ``score``: weight and 1000 times a Gumbel number that seed and row_id decide, so drawing the highest is sampling by weight without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``row_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and, where it is drawn, ``rank`` from 1.

    Drawn are floor(percent / 100) of the rows of at least ``least_words`` words,
    by falling score and rising row_id (null last, as equals of any order).  Null
    and empty texts have no words and aren't drawn; repeated rows each take part;
    an empty table gives no rows, an empty target smoothed shares alone.  Keys
    are whole numbers or null; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    rows = stored(scored(weigh(docs, gain, key, text), seed).withColumn("place", F.monotonically_increasing_id()), "weighed")
    spark = docs.sparkSession
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("row_id").asc_nulls_last(), F.col("place").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.withColumn("fits", F.col("n_words") >= least_words).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An id names the range and, from 0, the place in it.
    placed = stored(sorted_.withColumn("at", F.monotonically_increasing_id()).drop("place"), "placed")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit"))
    taken = (sizes.agg(F.sum("fit")).first()[0] or 0) * percent // 100
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per range
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(before, "part").select("row_id", "n_words", "n_features", "weight", "score", F.when(F.col("fits") & (rank <= taken), rank).alias("rank"))
