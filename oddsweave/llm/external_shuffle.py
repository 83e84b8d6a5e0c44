"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets that fit in memory, by a seeded
hash.  Pass two reads bucket after bucket and shuffles each by Fisher-Yates with
a seed of its own.  Buckets in order, and records in their order inside, are one
uniformly random order of all records; shards are equal runs of it, so their row
counts differ by one at most.

Records are written once with their hash before they are scattered, so counting
and scattering see the same rows and a lost executor's work is done again the
same way.  A record's bucket depends on the seed, its key and its text.  Rows
equal in both would all meet in one bucket; where they would fill more than a
sixteenth of one, they are dealt out by their place in what was written, in
pieces of that size.  Fewer than sixteen equal rows stay together, so where they
go doesn't depend on how the input is partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oddsweave.llm._shared import free_name, stored

BUCKET_BYTES = 16 << 20
#: Equal rows are dealt out in pieces of a bucket's bytes by this.
PIECES = 16
TOGETHER = 16
#: So many buckets at most have their sizes and their hot hashes (at most ``PIECES`` each) broadcast.
BROADCAST_BUCKETS = 20_000


def _fisher_yates(rows: int, seed: int, bucket: int) -> np.ndarray:
    """A uniformly random order (the generator's permutation is Fisher-Yates)."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(rows)


def _shuffled(seed: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["_bucket"][0].as_py()
        # The order in which records arrive must not matter.
        table = table.take(pc.sort_indices(table.select(["_order", "_place"]), sort_keys=[("_order", "ascending"), ("_place", "ascending")]))
        n = table.num_rows
        table = table.take(pa.array(_fisher_yates(n, seed, bucket)))
        return table.set_column(table.schema.get_field_index("_order"), "_order", pa.array(np.arange(n, dtype=np.int64)))

    return run


def text_size(text: Column) -> Column:
    """Bytes that a record counts: its text's UTF-8 bytes (null: none) and 8 more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _whole(a: Column, by: int) -> Column:
    """Whole quotient of a number that isn't negative."""
    return ((a - F.pmod(a, F.lit(by))) / by).cast("long")


def shuffle(docs: DataFrame, shards: int = 24, seed: int = 20240117, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``shard`` (0 to shards-1), ``slot`` (gapless from 0 in a shard) and ``bucket``.

    Null keys and texts take part like others, keys may be of any type; repeated
    rows each get a slot; an empty table gives no rows.  Where ``docs`` has a
    column of one of the three names, the new one has an underscore behind it.
    Where buckets begin is a running sum over one row a bucket, in one task.
    """
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")
    hashed = stored(docs.select(record, F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_hash"), text_size(F.col(f"`{text}`")).alias("_size"), F.monotonically_increasing_id().alias("_place")), "records")
    counts = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))
    rows, size = counts.agg(F.sum("n"), F.sum("bytes")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    small = lambda df: F.broadcast(df) if buckets <= BROADCAST_BUCKETS else df
    hot = counts.filter((F.col("n") >= TOGETHER) & (F.col("bytes") * PIECES > bucket_bytes)).select("_hash", F.ceil(F.col("bytes") * PIECES / bucket_bytes).alias("_salts"))
    salted = hashed.join(small(hot), "_hash", "left")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod("_place", "_salts"))
    placed = salted.withColumn("_order", F.xxhash64(F.lit(seed + 1), F.col("_hash"), salt)).withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    scattered = placed.repartition(max(1, min(buckets, 100_000)), "_bucket").select("record", "_order", "_place", "_bucket")
    schema = StructType([hashed.schema["record"], *(StructField(c, LongType()) for c in ("_order", "_place", "_bucket"))])
    mixed = scattered.groupBy("_bucket").applyInArrow(_shuffled(seed), schema)
    # One row a bucket: where it begins in the order of all.
    per_bucket = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    begins = per_bucket.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_begin"))
    few, more = divmod(rows or 0, shards)
    rank = F.col("_begin") + F.col("_order")
    cut = more * (few + 1)  # the first ``more`` shards have one row more
    longer = _whole(rank, few + 1)
    shorter = F.lit(more) + _whole(rank - cut, max(few, 1))
    shard = F.when(rank < cut, longer).otherwise(shorter)
    slot = F.when(rank < cut, rank - longer * (few + 1)).otherwise(rank - cut - (shorter - more) * max(few, 1))
    own = [F.col("record").getField(c).alias(c) for c in docs.columns]
    shard_as, slot_as, bucket_as = (free_name(c, docs.columns) for c in ("shard", "slot", "bucket"))
    return mixed.join(small(begins), "_bucket").select(*own, shard.cast("int").alias(shard_as), slot.alias(slot_as), F.col("_bucket").alias(bucket_as))


def write(docs: DataFrame, path: str, shards: int = 24, seed: int = 20240117) -> None:
    """Shuffles ``docs`` and writes each bucket where it lies, into folders by shard; a file's rows are in slot order.

    No second shuffle: a bucket is a run of the order of all, so a task adds a
    file to few shards.  Null and repeated rows and clashing names as in ``shuffle``.
    """
    out = shuffle(docs, shards, seed)
    shard, slot = free_name("shard", docs.columns), free_name("slot", docs.columns)
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
