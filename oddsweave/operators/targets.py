"""Which fixtures, links and prices a run works on: windows, targets, work left, remembered and latest links, groups of flat prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prematch_counts(fixtures: DataFrame, as_of: Column) -> DataFrame:
    """Per league the fixtures that are still ahead, those that are not, and all."""
    ahead = F.col("starts_at") >= as_of
    return fixtures.groupBy("league_id").agg(F.count_if(ahead).alias("targeted"), F.count_if(~ahead).alias("skipped"), F.count(F.lit(1)).alias("available"))


def canonical_window(fixtures: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Fixtures that start after now and before so many days."""
    return fixtures.filter((F.col("starts_at") > as_of) & (F.col("starts_at") < F.date_add(as_of, days)))


def around_dates(fixtures: DataFrame, as_of: Column, before: int = 1, after: int = 1) -> DataFrame:
    """Fixtures by date key, from so many days before today to so many after."""
    return fixtures.filter(F.col("date_key").between(F.date_sub(F.to_date(as_of), before), F.date_add(F.to_date(as_of), after)))


def active_targets(fixtures: DataFrame, leagues: DataFrame, finished: Sequence[str]) -> DataFrame:
    """Fixtures of target leagues that are in no finished state."""
    return fixtures.filter(~F.col("status").isin(*finished)).join(leagues.select("league_id").distinct(), "league_id", "left_semi")


def work_left(links: DataFrame, fixtures: DataFrame, prices: DataFrame, changed: Column) -> DataFrame:
    """Links to process: without an address, with a fixture that is gone, or changed and without prices."""
    rows = links.join(fixtures.select("fixture_id", F.lit(True).alias("_fixture")).distinct(), "fixture_id", "left")
    rows = rows.join(prices.select("fixture_id", "bookmaker", F.lit(True).alias("_priced")).distinct(), ["fixture_id", "bookmaker"], "left")
    return rows.filter(F.col("source_url").isNull() | F.col("_fixture").isNull() | (F.col("_priced").isNull() & changed)).select(*links.columns)


def collection_window(fixtures: DataFrame, hours: int = 1) -> DataFrame:
    """Per league from when to when it is collected, and on how many days."""
    margin, at = F.make_interval(hours=F.lit(hours)), F.col("starts_at").cast("timestamp")
    return fixtures.groupBy("league_id").agg((F.min(at) - margin).alias("opens"), (F.max(at) + margin).alias("closes"), F.count_distinct("date_key").alias("days"))


def best_origin(*origins: DataFrame) -> DataFrame:
    """Addresses (column url) of several origins, the best first: each once, with the number of its best origin."""
    rows = None
    for k, df in enumerate(origins, 1):
        part = df.select("url", F.lit(k).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("url").agg(F.min("priority").alias("priority"))


def with_league(fixtures: DataFrame, leagues: DataFrame) -> DataFrame:
    """Fixtures and whether their league is enabled; null where it is not known."""
    return fixtures.join(leagues.select("league_id", "enabled"), "league_id", "left")


def enabled_prices(prices: DataFrame, fixtures: DataFrame, leagues: DataFrame, bookmakers: DataFrame) -> DataFrame:
    """Prices of enabled leagues with the bookmaker's columns and the league."""
    enabled = fixtures.select("fixture_id", "league_id").join(leagues.filter("enabled").select("league_id"), "league_id", "left_semi")
    return prices.join(enabled, "fixture_id").join(bookmakers, "bookmaker")


def remembered_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` with ``remembered``: the known event of the same id, or else the smallest of the same address.

    ``known``: id and url.
    """
    by_id = known.select(F.col("id").alias("external_event_id"), F.col("id").alias("_same")).distinct()
    by_url = known.filter("url IS NOT NULL").groupBy(F.col("url").alias("source_url")).agg(F.min("id").alias("_near"))
    rows = links.join(by_id, "external_event_id", "left").join(by_url, "source_url", "left")
    return rows.select(*links.columns, F.coalesce("_same", "_near").alias("remembered"))


def not_collected(fixtures: DataFrame, collected: DataFrame) -> DataFrame:
    return fixtures.join(collected.select("fixture_id").distinct(), "fixture_id", "left_anti")


def latest_link(links: DataFrame) -> DataFrame:
    """Per fixture the event that was linked last, of several the one of the largest id."""
    return links.groupBy("fixture_id").agg(F.max_by("external_event_id", F.struct("updated_at", "external_event_id")).alias("external_event_id"))


def top_of(rows: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def latest(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of all, from the first ``k`` of each task."""
    return rows.orderBy(*order).limit(k)


def group_prices(prices: DataFrame) -> DataFrame:
    """Flat prices to one row per source id: the first row gives the fixture; how many, and which selections."""
    first = F.min_by("fixture_id", F.struct("bookmaker", "selection", "price", "fixture_id"))
    return prices.groupBy("source_odd_id").agg(first.alias("fixture_id"), F.count(F.lit(1)).alias("n_prices"), F.array_sort(F.collect_set("selection")).alias("selections"))


def best_priority(prices: DataFrame, sides: int = 3) -> DataFrame:
    """Per fixture and category the complete group of the best priority; ``prices`` have a ``priority``."""
    groups = prices.groupBy("fixture_id", "pa_category", "priority").agg(F.count_distinct("selection").alias("_sides"), F.max("price").alias("top"))
    best = F.max_by(F.struct("priority", "top"), "priority")
    return groups.filter(F.col("_sides") == sides).groupBy("fixture_id", "pa_category").agg(best.alias("g")).select("fixture_id", "pa_category", "g.*")


def fetch_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in force."""
    return blocks.filter("blocked").select("fixture_id", "bookmaker", "scope", "attempts")


def having_tokens(rows: DataFrame, column: str, *wanted: str) -> DataFrame:
    """Rows whose text has all the words."""
    words = F.split(F.col(column), " ")
    return rows.filter(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(words, w)))


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hours: int = 24, ts: str = "ts", **values: Column) -> DataFrame:
    """``rows`` with the last value so far, in the order, of each column that isn't null.

    A key's rows are taken in buckets of ``hours``, so a long history is not one
    task's; what a bucket ends with is carried into the next by one row a bucket.
    """
    bucket = F.floor(F.unix_micros(F.col(ts)) / (hours * 3_600_000_000))
    rows = rows.withColumn("_bucket", bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "_bucket").agg(*(F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*keys, "_bucket", *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values))
    out = rows.join(edges, [*keys, "_bucket"])
    here = {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")) for n in values}
    return out.withColumns(here).drop("_bucket", *(f"_{k}_{n}" for k in "vb" for n in values))
