"""Consensus sweep: sources whose implied probabilities leave the median of the others.

Prices have fixture_id, bookmaker, selection, pa_category and price.  All state
is keyed by (fixture, bookmaker); a group holds one number per bookmaker, so its
array is as long as the list of bookmakers and the median needs no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET = "1X2"
MIN_BOOKMAKERS = 4
MAX_DEVIATION_PP = 20.0
MAX_ATTEMPTS = 3


def implied(prices: DataFrame) -> DataFrame:
    """The best price's probability per fixture, category, selection and bookmaker; only finite prices above 1 of the result market."""
    good = prices.filter((F.col("market_code") == MARKET) & (F.col("price") > 1) & (F.col("price") < float("inf")))
    return good.groupBy("fixture_id", "pa_category", "selection", "bookmaker").agg(F.min(1 / F.col("price")).alias("implied"))


def enough_bookmakers(groups: DataFrame) -> DataFrame:
    """Fixtures (fixture_id, n_bookmakers) with enough distinct bookmakers."""
    return groups.groupBy("fixture_id").agg(F.count_distinct("bookmaker").alias("n_bookmakers")).filter(F.col("n_bookmakers") >= MIN_BOOKMAKERS)


def _without(values: Column, at: Column) -> Column:
    """Median of a sorted array without the element at the 0-based place ``at``."""
    left = F.size(values) - 1
    pick = lambda k: F.element_at(values, F.when(k < at, k).otherwise(k + 1).cast("int") + 1)
    low, high = F.floor((left - 1) / 2), F.floor(left / 2)
    return (pick(low) + pick(high)) / 2


def leave_one_out(groups: DataFrame) -> DataFrame:
    """Each bookmaker's probability, the median of the others' and the deviation in points; groups of enough bookmakers only."""
    # A selection with so many bookmakers has a fixture with as many: the fixture's own gate lets all of these through.
    sets = groups.groupBy("fixture_id", "pa_category", "selection").agg(F.array_sort(F.collect_list(F.struct("implied", "bookmaker"))).alias("all"))
    values = sets.filter(F.size("all") >= MIN_BOOKMAKERS).withColumn("values", F.col("all.implied"))
    each = values.select("fixture_id", "pa_category", "selection", "values", F.posexplode("all").alias("at", "own"))
    others = _without(F.col("values"), F.col("at"))
    return each.select(
        "fixture_id",
        F.col("own.bookmaker").alias("bookmaker"),
        "pa_category",
        "selection",
        F.col("own.implied").alias("implied"),
        others.alias("others_median"),
        (F.abs(F.col("own.implied") - others) * 100).alias("deviation_pp"),
    )


def _fixed1(value: Column) -> Column:
    return F.format_string("%.1f", value)


def mismatches(prices: DataFrame, max_deviation: float = MAX_DEVIATION_PP) -> DataFrame:
    """fixture_id, bookmaker, scope (EVENTO or PARCIAL), pa_category, worst_pp, reason.

    A category is corrupt when two of its selections deviate (one, if only one
    was evaluated).  All evaluated categories corrupt: the whole event is wrong;
    else every deviating category is reported by itself.
    """
    off = F.col("deviation_pp") > max_deviation
    # Best prices are few for each fixture, and all below is grouped within fixtures: one exchange of them serves all of it.
    by_pa = (
        leave_one_out(implied(prices).repartition("fixture_id"))
        .groupBy("fixture_id", "bookmaker", "pa_category")
        .agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(off).alias("deviating"), F.max(F.when(off, F.col("deviation_pp"))).alias("worst"))
    )
    corrupt = (F.col("deviating") > 0) & (F.col("deviating") >= F.least(F.lit(2), F.col("evaluated")))
    cell = F.struct("pa_category", "worst")
    by_source = by_pa.groupBy("fixture_id", "bookmaker").agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(corrupt).alias("corrupt"),
        F.max("worst").alias("worst"),
        F.collect_list(F.when(F.col("deviating") > 0, cell)).alias("cells"),
    )
    whole = F.array(F.struct(F.lit("EVENTO").alias("scope"), F.lit("").alias("pa_category"), F.col("worst").alias("worst_pp"), F.concat(F.lit("todos os mercados fora do consenso (max "), _fixed1(F.col("worst")), F.lit("pp)")).alias("reason")))
    parts = F.transform(
        "cells",
        lambda c: F.struct(F.lit("PARCIAL").alias("scope"), c["pa_category"].alias("pa_category"), c["worst"].alias("worst_pp"), F.concat(c["pa_category"], F.lit(" fora do consenso (max "), _fixed1(c["worst"]), F.lit("pp)")).alias("reason")),
    )
    wrong = F.when((F.col("corrupt") > 0) & (F.col("corrupt") == F.col("categories")), whole).otherwise(parts)
    return by_source.filter(F.size("cells") > 0).select("fixture_id", "bookmaker", F.inline(wrong))


def changed_fixtures(prices: DataFrame, since, column: str = "updated_at") -> DataFrame:
    """Fixtures with a result price newer than the watermark; all of them on the first run (``since`` is None)."""
    prices = prices.filter(F.col("market_code") == MARKET)
    rows = prices if since is None else prices.filter(F.col(column) > F.lit(since))
    return rows.select("fixture_id").distinct()


def sweep(prices: DataFrame, upcoming: DataFrame, since=None, column: str = "updated_at") -> DataFrame:
    """Mismatches of upcoming fixtures that changed; a fixture is judged by all its prices, not just the new ones."""
    due = changed_fixtures(prices, since, column).join(upcoming.select("fixture_id").distinct(), "fixture_id", "left_semi")
    return mismatches(prices.join(due, "fixture_id", "left_semi"))


def next_blocks(found: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks after a sweep: attempts, blocked and rejected event ids of every mismatch.

    ``blocks``: fixture_id, bookmaker, scope, pa_category, attempts,
    rejected_event_ids; ``links``: fixture_id, bookmaker, external_event_id.
    """
    key = ["fixture_id", "bookmaker", "scope", "pa_category"]
    linked = links.groupBy("fixture_id", "bookmaker").agg(F.collect_set(F.col("external_event_id").cast("string")).alias("linked"))
    rows = found.join(blocks.select(*key, "attempts", "rejected_event_ids"), key, "left").join(linked, ["fixture_id", "bookmaker"], "left")
    event = F.col("scope") == "EVENTO"
    tries = F.coalesce("attempts", F.lit(0)) + F.when(event, 1).otherwise(0)
    none = F.array().cast("array<string>")
    before = F.coalesce("rejected_event_ids", none)
    return rows.select(
        *key,
        F.when(event, F.least(tries, F.lit(MAX_ATTEMPTS + 1))).otherwise(tries).cast("int").alias("attempts"),
        F.when(event, tries > MAX_ATTEMPTS).otherwise(True).alias("blocked"),
        F.array_sort(F.when(event, F.array_union(before, F.coalesce("linked", none))).otherwise(before)).alias("rejected_event_ids"),
        "reason",
    )


def surviving_prices(prices: DataFrame, found: DataFrame) -> DataFrame:
    """Prices after a sweep: all those of wrong events go, and the result prices of wrong categories."""
    out = prices.join(found.filter("scope = 'EVENTO'").select("fixture_id", "bookmaker").distinct(), ["fixture_id", "bookmaker"], "left_anti")
    key = ["fixture_id", "bookmaker", "pa_category"]
    parts = found.filter("scope = 'PARCIAL'").select(*key, F.lit(MARKET).alias("market_code")).distinct()
    return out.join(parts, [*key, "market_code"], "left_anti")


def surviving_links(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links after a sweep: those of wrong events go, so that the next collection links anew."""
    key = ["fixture_id", "bookmaker"]
    return links.join(found.filter("scope = 'EVENTO'").select(*key).distinct(), key, "left_anti").select(*links.columns)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("mismatches"),
        F.count_if(F.col("scope") == "EVENTO").alias("event_mismatches"),
        F.count_if(F.col("scope") == "PARCIAL").alias("partial_mismatches"),
        F.count_distinct("fixture_id").alias("fixtures"),
    )
