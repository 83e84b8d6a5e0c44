"""Exact duplicates by sorting content, with DataFrame functions alone.

Splitters are sampled from the contents (the first bytes, then a hash of all,
so a splitter is short however long the text), and rows are dealt to ranges by
them.  Each range is sorted outside memory by head, hash and whole bytes, so
equal texts lie side by side; a window that parts its rows wherever a whole
text differs from its neighbour's numbers them, and the one with the smallest
(or largest) key stays.

Contents that would fill more than half an even range, in rows or in bytes, are
found first by counting hashes and dealt over as many ranges as they need.  Each
range then hands on one row per such content, and those few rows are compared
once more, in full.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsweave.llm._shared import removed, row_key, stored

HEAD_BYTES = 16
RANGE_BYTES = 64 << 20
MOST_RANGES = 100_000
#: Contents that fill over half a range are at most four per range; they are broadcast up to so many ranges.
BROADCAST_RANGES = 20_000


def _unchanged(text: Column) -> Column:
    return text


@contextmanager
def _window_rows(spark: SparkSession, rows: int):
    """Rows of a window that stay outside managed memory; more of them can spill."""
    name = "spark.sql.windowExec.buffer.in.memory.threshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _bounded(df: DataFrame, ranges: int) -> DataFrame:
    return F.broadcast(df) if ranges <= BROADCAST_RANGES else df


def _classed(docs: DataFrame, record: Column, key: str, text: str, normal: Callable[[Column], Column], largest: bool) -> DataFrame:
    """Each row's ``record`` with the key that its text keeps, the text's rows, whether it is the one that stays, and the text's digest."""
    spark = docs.sparkSession
    body = normal(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("binary")
    rows = docs.select(record.alias("record"), row_key(docs, key).alias("own"), body.alias("body"), F.monotonically_increasing_id().alias("place"))
    rows = rows.select("*", F.substring("body", 1, HEAD_BYTES).alias("head"), F.xxhash64("body").alias("hash"))
    counts = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body").cast("long") + 8).alias("bytes")), "contents")
    n, size = counts.agg(F.sum("n"), F.sum("bytes")).first()
    n, size = n or 1, size or 1
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    pieces = F.ceil(F.greatest(F.col("n") * (2 * ranges / n), F.col("bytes") * (2 * ranges / size)))
    hot = counts.select("hash", pieces.alias("pieces")).filter("pieces > 1")
    dealt = (
        rows.join(_bounded(hot, ranges), "hash", "left")
        .withColumn("salt", F.when(F.col("pieces").isNotNull(), F.pmod("place", "pieces")).otherwise(F.lit(0)).cast("long"))
        .repartitionByRange(ranges, "head", "hash", "salt")
    )
    first = F.col("own").desc_nulls_last() if largest else F.col("own").asc_nulls_last()
    equal = Window.partitionBy("head", "hash", "salt", "body").orderBy(first, "place")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "record", "hash", "salt", "pieces", "body",
        (F.row_number().over(equal) == 1).alias("leads"),
        F.first("own").over(whole).alias("best"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    # Texts end here, but for one row of a content that was dealt over several ranges.
    runs = runs.select("record", "hash", "salt", "leads", "best", "n", F.sha2("body", 256).alias("sha"), F.when(F.col("leads") & F.col("pieces").isNotNull(), F.col("body")).alias("body"))
    with _window_rows(spark, 16):
        runs = stored(runs, "runs")
    removed(counts)
    known = F.col("best").isNotNull()
    rank = F.max(F.struct(known, "best", -F.col("salt"))) if largest else F.min(F.struct(~known, "best", "salt"))
    united = runs.filter(F.col("body").isNotNull()).groupBy("hash", "body", "sha").agg(F.sum("n").alias("all"), rank.alias("rank"))
    united = united.select(F.col("hash"), F.col("sha"), F.col("all"), F.col("rank.best").alias("top"), F.abs(F.col("rank")[united.schema["rank"].dataType.names[2]]).alias("home"))
    joined = runs.drop("body").join(_bounded(united, ranges), ["hash", "sha"], "left")
    parted = F.col("all").isNotNull()
    return joined.select(
        "record",
        F.when(parted, F.col("top")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("all", "n").alias("group_size"),
        (F.col("leads") & (~parted | (F.col("salt") == F.col("home")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = _unchanged, largest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``row_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when ``normal`` gives the same bytes; a null text counts as
    empty, and so do all empty texts.  Of equal texts the row with the smallest
    key stays (``largest``: the largest); a null key comes after all others, and
    of rows with equal keys exactly one stays.  Keys are whole numbers or null;
    an empty table gives no rows; other columns are not read.
    """
    found = _classed(docs, row_key(docs, key), key, text, normal, largest)
    return found.withColumnRenamed("record", "row_id")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = _unchanged, largest: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Null keys and texts, repeated rows and empty tables as in ``classes``; texts stay as they were.
    """
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = _classed(docs, record, key, text, normal, largest)
    return found.filter("kept").select(*(F.col("record").getField(c).alias(c) for c in docs.columns))
