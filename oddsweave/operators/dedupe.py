"""Set operators by key, with a stated order instead of arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by ``order``.  One aggregation with partial maxima, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def feeds_united(*feeds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of several feeds; of equal keys the last by ``order`` stays."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return last_wins(out, keys, order)


def stale(existing: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(current.select(*keys).distinct(), keys, "left_anti")


def changed(upcoming: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    return upcoming.join(touched.select(*keys).distinct(), keys, "left_semi")


def united_ids(df: DataFrame, left: str, right: str) -> DataFrame:
    """Both id arrays as one, distinct and in order."""
    return df.withColumn("ids", F.array_sort(F.array_union(F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))))


def own_link_only(links: DataFrame, pattern: str = r"/(\d+)(?:[/?#]|$)") -> DataFrame:
    """Of several links of a fixture to one page keep that whose id the page's address has; if none has it, all."""
    keyed = links.withColumn("_own", F.coalesce(F.regexp_extract("source_url", pattern, 1) == F.col("external_event_id").cast("string"), F.lit(False)))
    groups = keyed.groupBy("fixture_id", "source_url").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_own").alias("_any"))
    return keyed.join(groups, ["fixture_id", "source_url"]).filter((F.col("_n") < 2) | ~F.col("_any") | F.col("_own")).select(*links.columns)
